"""The same results in SQL, written independently, to check the suite against another engine."""

from __future__ import annotations

import math
import re

from lotwise import catalog as K
from lotwise.functions.geometry import LAMBERT93
from lotwise.operators.terrain_flow import sky_offsets

# the five compared scores, features and their fixed linear weights
FEATURES = K.FEATURES
WEIGHTS = {
    "slope_p50": -0.8, "slope_p90": -0.6, "slope_std": -0.3, "twi_mean": -0.25, "has_thalweg_mean": -2.0,
    "profile_curvature_mean": 1.5, "tri_mean": -0.4, "hillshade_winter_mean": 0.9, "aspect_south_ratio_mean": 1.1,
    "svf_mean": 0.7,
}
CONSENSUS = ["CPI_v3", "cluster_score", "CPI_market", "CPI_preference"]
PROFILE = [*K.CLUSTER_LOWER_IS_BETTER, *K.CLUSTER_HIGHER_IS_BETTER]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def R(expr: str, name: str | None = None) -> str:
    """Six digits, ties upward, without negative zero."""
    return f"round_even((({expr})::double + 3.7e-10::double)*1000000.0::double, 0)/1000000.0::double + 0.0::double as {name or expr}"


def RS(*names: str) -> str:
    return ", ".join(R(n) for n in names)


def h1(expr: str) -> str:
    """One digit, half to even."""
    return f"round_even(({expr})*10.0::double, 0)/10.0::double"


def clip(x: str, lo: float, hi: float) -> str:
    return f"(case when {x} is null then null else least(greatest({x}, {lo}::double), {hi}::double) end)"


def norm(col: str, invert: bool = False, stretch: bool = False, lo: str | None = None, hi: str | None = None, fill: str | None = None) -> str:
    lo, hi, fill = lo or f"{col}_lo", hi or f"{col}_hi", fill or f"{col}_fill"
    n = f"((least(greatest(coalesce({col},{fill}),{lo}),{hi})-{lo})/({hi}-{lo}))"
    if stretch:
        a, b = 1 / (1 + math.exp(3.0)), 1 / (1 + math.exp(-3.0))
        n = f"((1.0::double/(1.0::double+exp(({n}-0.5::double)*-6.0::double))-{a!r}::double)/({b - a + 1e-9!r}::double))"
    if invert:
        n = f"(1.0::double-{n})"
    return f"(case when {lo}={hi} then 0.5::double else {n} end)"


def softmin(cols: list[str], tau: str) -> str:
    low = f"least({','.join(cols)})"
    w = [f"exp(({low}-{c})/{tau}::double)" for c in cols]
    return f"(({'+'.join(f'{a}*{c}' for a, c in zip(w, cols))})/({'+'.join(w)}))"


def ladder(x: str, steps, missing: str | None = None) -> str:
    out = "case " + (f"when {x} is null then {q(missing)} " if missing else "")
    for bound, label in steps:
        out += f"else {q(label)} end" if bound is None else f"when {x} < {bound} then {q(label)} "
    return out


def weighted(parts: dict[str, float]) -> str:
    return "+".join(f"{c}*{w}::double" for c, w in parts.items())


SCALED = [*FEATURES, "compactness_ratio"]


def stats(source: str, cols=SCALED) -> str:
    """One row: fill value and percentile ends of every filled column."""
    med = ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0.5::double) {c}_fill" for c in cols)
    ends = ", ".join(
        f"any_value({c}_fill) {c}_fill, quantile_cont(coalesce({c},{c}_fill),0.01) {c}_lo, quantile_cont(coalesce({c},{c}_fill),0.99) {c}_hi" for c in cols
    )
    return f"select {ends} from {source} cross join (select {med} from {source})"


def sun(svf: bool = True) -> str:
    a, b, c = norm("aspect_south_ratio_mean"), norm("hillshade_winter_mean"), norm("svf_mean")
    return f"({a}*0.40::double+{b}*0.35::double+{c}*0.25::double)" if svf else f"({a}*0.57::double+{b}*0.43::double)"


def group_score_columns() -> str:
    slope = f"{norm('slope_p50', True, True)}*0.40::double+{norm('slope_p90', True, True)}*0.35::double+{norm('slope_std', True)}*0.25::double"
    hydro = f"{norm('twi_mean', True, True)}*(1.0::double-least(greatest(coalesce(has_thalweg_mean,0),0),1)*0.4::double)"
    morpho = f"{norm('profile_curvature_mean')}*0.44::double+{norm('tri_mean', True)}*0.36::double+{norm('compactness_ratio')}*0.20::double"
    parts = {"score_pente": slope, "score_hydro": hydro, "score_morpho": morpho, "score_soleil": sun()}
    return ", ".join(f"{h1(f'({e})*100.0::double')} {n}" for n, e in parts.items())


G4 = {"score_pente": 0.35, "score_hydro": 0.30, "score_morpho": 0.20, "score_soleil": 0.15}
G3 = {"score_pente": 0.40, "score_hydro": 0.35, "score_morpho": 0.25}
TAU = "10.0"


def pct_rank(x: str) -> str:
    return (
        f"case when {x} is not null then (rank() over (order by {x} asc nulls last) + (count(*) over (partition by {x}) - 1)/2.0::double)"
        f"/count({x}) over () * 100.0::double end"
    )


STENCIL = """
  select a.r, a.c, a.z,
    coalesce(lag(a.c) over wr = a.c-1, false) has_w, coalesce(lead(a.c) over wr = a.c+1, false) has_e,
    case when coalesce(lag(a.c) over wr = a.c-1, false) then lag(a.z) over wr else a.z end w,
    case when coalesce(lead(a.c) over wr = a.c+1, false) then lead(a.z) over wr else a.z end e
  from fx_cells a window wr as (partition by a.r order by a.c)
"""

CTE: dict[str, str] = {
    "fx_parcels": """select o_orderkey as parcel_id, cast(925000+(o_orderkey*7919)%4000 as double) xmin,
      cast(6499000+(o_orderkey*104729)%6000 as double) ymin,
      cast(925005+(o_orderkey*7919)%4000+(o_orderkey*31)%80 as double) xmax,
      cast(6499005+(o_orderkey*104729)%6000+(o_orderkey*17)%80 as double) ymax from orders""",
    "fx_buildings": """select c_custkey as building_id, cast(925000+(c_custkey*6007)%4000 as double) xmin,
      cast(6499000+(c_custkey*90001)%6000 as double) ymin, cast(925004+(c_custkey*6007)%4000+(c_custkey*13)%30 as double) xmax,
      cast(6499004+(c_custkey*90001)%6000+(c_custkey*11)%30 as double) ymax from customer""",
    "fx_zones": """select s_suppkey as zone_id, cast(925000+(s_suppkey*1301)%4000 as double) xmin,
      cast(6499000+(s_suppkey*2903)%6000 as double) ymin, cast(925600+(s_suppkey*1301)%4000 as double) xmax,
      cast(6499900+(s_suppkey*2903)%6000 as double) ymax,
      case s_nationkey%7 when 0 then 'U' when 1 then ' ub ' when 2 then 'AU' when 3 then 'Nh' when 4 then 'A' when 5 then 'UA' else null end typezone
      from supplier""",
    "fx_hazard_points": """select p_partkey as hazard_id, cast(925000+(p_partkey*3571)%4000 as double)+0.5::double x,
      cast(6499000+(p_partkey*7187)%6000 as double)+0.5::double y,
      case when p_partkey%3=0 then 'argiles' else 'mvt_terrain' end layer from part""",
    "fx_roads": """select n_nationkey as road_id, 925000.0::double x1, cast(6499000+n_nationkey*240 as double) y1,
      929000.0::double x2, cast(6499000+(n_nationkey*997)%6000 as double) y2 from nation""",
    "fx_cells": """select r, c, case when k%211=0 then null else cast((r*r*3+c*c*5+r*c)%997 as double)/10.0::double end z
      from (select o_orderkey//50 r, o_orderkey%50 c, o_orderkey k from orders)""",
    "fx_sales": """select cast(l_partkey as varchar) id_parcelle, l_extendedprice valeur_fonciere,
      case when l_linenumber=7 then 0.0::double else l_quantity end surface_terrain,
      case when l_returnflag='R' then 'Echange' when l_returnflag='A' then 'Vente' else 'Vente en l''etat futur d''achevement' end nature_mutation,
      case when l_suppkey%3=0 then '73065' else '73008' end code_commune from lineitem""",
    "fx_features": """select l_partkey as parcel_id, quantile_cont(l_quantity*(0.1::double+0.08::double*(l_partkey%10)),0.5) slope_p50,
      quantile_cont(l_quantity*(0.1::double+0.08::double*(l_partkey%10)),0.9) slope_p90,
      stddev_pop(l_quantity*(0.1::double+0.08::double*(l_partkey%10))) slope_std,
      case when l_partkey%11=0 then null else avg(l_extendedprice)/10000 end twi_mean,
      avg(case when l_discount>0.07::double then 1.0::double else 0.0::double end)*(l_partkey%4)/3 has_thalweg_mean,
      avg(l_tax)-0.04::double profile_curvature_mean,
      avg(l_quantity*(0.1::double+0.08::double*(l_partkey%10)))/20 tri_mean, avg(l_discount)*8 hillshade_winter_mean,
      avg(case when l_linenumber<=3 then 1.0::double else 0.0::double end) aspect_south_ratio_mean,
      case when l_partkey%7=0 then null else avg(l_tax)*10 end svf_mean,
      cast(10+(l_partkey*37)%6000 as double) surface_m2,
      case l_partkey%7 when 0 then 'U' when 1 then 'UA' when 2 then 'UB' when 3 then 'AU' when 4 then 'N' when 5 then 'A' else 'inconnu' end zone_plu,
      case when l_partkey%13=0 then null else cast((l_partkey*29)%101 as double) end cluster_score
      from lineitem group by l_partkey""",
    "fx_market": """select ' 73065-ab ' || cast(p_partkey as varchar) id_parcelle, cast((p_partkey*17)%101 as double) CPI_market from part where p_partkey%3<>1""",
    "fx_preference": """select '73065AB' || cast(p_partkey as varchar) id_parcelle_norm,
      case when p_partkey%10=4 then null else cast((p_partkey*23)%97 as double) end CPI_preference from part where p_partkey%2=0""",
    "fx_ml": """select *, CPI_ML_v3-2.0::double*cpi_ml_std cpi_ml_ci_low, CPI_ML_v3+2.0::double*cpi_ml_std cpi_ml_ci_high from (
      select p_partkey as parcel_id, case when p_partkey%17=0 then null else cast((p_partkey*53)%1001 as double)/10.0::double end CPI_ML_v3,
      cast((p_partkey*7)%90 as double)/10.0::double cpi_ml_std from part)""",
    "shape": """select parcel_id, w*h area_m2, 2*(w+h) perimeter_m, (xmin+xmax)/2 cx, (ymin+ymax)/2 cy,
      4*pi()*w*h/((2*(w+h))*(2*(w+h))) compactness_ratio, greatest(w,h)/least(w,h) elongation_ratio,
      cast(trunc((xmin+xmax)/2/300) as bigint) || '_' || cast(trunc((ymin+ymax)/2/300) as bigint) block_id
      from (select *, xmax-xmin w, ymax-ymin h from fx_parcels)""",
    "built": """select p.parcel_id, coalesce(sum((least(p.xmax,b.xmax)-greatest(p.xmin,b.xmin))*(least(p.ymax,b.ymax)-greatest(p.ymin,b.ymin))) filter (where b.building_id is not null),0.0::double) built_area
      from fx_parcels p left join fx_buildings b on p.xmin<=b.xmax and b.xmin<=p.xmax and p.ymin<=b.ymax and b.ymin<=p.ymax group by p.parcel_id""",
    "ces": """select parcel_id, ces_existant, greatest(0.0::double, 0.40::double-ces_existant) ces_residuel,
      greatest(0.0::double, 0.40::double-ces_existant)*area_m2 emprise_residuelle_m2 from (
      select s.parcel_id, area_m2, least(greatest(built_area/area_m2,0),1) ces_existant from shape s join built b on s.parcel_id=b.parcel_id)""",
    "flags": """select p.parcel_id, count(*) filter (where h.layer='argiles')>0 brgm_argiles_flag, count(*) filter (where h.layer='mvt_terrain')>0 brgm_mvt_terrain_flag
      from fx_parcels p left join fx_hazard_points h on h.x between p.xmin and p.xmax and h.y between p.ymin and p.ymax group by p.parcel_id""",
    "features": """select p.parcel_id, f.* exclude (parcel_id, surface_m2, zone_plu), cast(10+(p.parcel_id*37)%6000 as double) surface_m2,
      case p.parcel_id%7 when 0 then 'U' when 1 then 'UA' when 2 then 'UB' when 3 then 'AU' when 4 then 'N' when 5 then 'A' else 'inconnu' end zone_plu, s.compactness_ratio, s.elongation_ratio, s.block_id, c.ces_existant, c.ces_residuel, c.emprise_residuelle_m2,
      g.brgm_argiles_flag, g.brgm_mvt_terrain_flag, '73065' commune from fx_parcels p left join fx_features f on f.parcel_id=p.parcel_id left join shape s on p.parcel_id=s.parcel_id
      left join ces c on p.parcel_id=c.parcel_id left join flags g on p.parcel_id=g.parcel_id""",
    "validated": "select *, (nan_ratio<=0.40 and surface_m2<=5000 and surface_m2>=20 and zone_plu in ('U','AU','UB','UC','UD','UE','UF','AUB','inconnu')) is_valid from (select *, ("
    + "+".join(f"(case when {c} is null then 1 else 0 end)" for c in FEATURES) + ")/10.0::double nan_ratio from features)",
    "scaling": stats("validated"),
    "grouped": f"select v.*, {group_score_columns()} from validated v cross join scaling",
    "raw0": f"select *, {h1(weighted(G4))} score_continu, {h1(softmin(list(G4), TAU))} score_softmin from grouped",
    "raw1": f"select *, {h1('score_continu*0.70::double+score_softmin*0.30::double')} cpi_brut from raw0",
    "gated": """select *, least(1.0::double, case when has_thalweg_mean>0.20 then 30.0::double/greatest(cpi_brut,1) else 1.0::double end,
      case when slope_p90>25 then 25.0::double/greatest(cpi_brut,1) else 1.0::double end,
      case when ces_existant>0.80 then 40.0::double/greatest(cpi_brut,1) else 1.0::double end) gate_factor,
      case when slope_p90>25 then 'talweg+pente' when has_thalweg_mean>0.20 then 'talweg_central' when ces_existant>0.80 then 'parcelle_saturee_CES' else '' end gate_reason
      from raw1""",
    "final0": f"""select *, {h1(clip('cpi_brut*gate_factor', 0, 100))} CPI_v3,
      {h1(clip(h1(f"{h1(weighted(G3))}*0.70::double+{h1(softmin(list(G3), TAU))}*0.30::double") + '*gate_factor', 0, 100))} CPI_technique
      from gated""",
    "final1": f"""select f.*, {ladder('CPI_v3', K.LADDER_FINAL)} CPI_v3_label, {ladder('CPI_technique', K.LADDER_TECHNICAL)} CPI_technique_label,
      {h1(clip(sun() + '*100.0::double', 0, 100))} CPI_valeur,
      case when compactness_ratio<0.20 or elongation_ratio>3 then {q(K.SHAPE_WARNING)} else '' end shape_warning,
      case when emprise_residuelle_m2<80 then {q(K.COVERAGE_WARNING)} else '' end ces_warning
      from final0 f cross join scaling""",
    "sales0": """select *, valeur_fonciere/surface_terrain prix_m2 from fx_sales where contains(nature_mutation,'Vente') and valeur_fonciere>0 and surface_terrain>0
      and valeur_fonciere/surface_terrain between 10 and 10000""",
    "sales": """select * from sales0 where code_commune='73065' or (select count(*) from sales0 where code_commune='73065')<50""",
    "priceq": "select quantile_cont(prix_m2,0.2) p20, quantile_cont(prix_m2,0.5) med, quantile_cont(prix_m2,0.8) p80, count(*) n_sales from sales",
    "price": "select upper(trim(id_parcelle)) sale_id, median(prix_m2) median_price from sales group by 1",
    "votes": """select f.parcel_id,
      (coalesce(slope_p90,12)<10 and coalesce(slope_std,6)<5 and coalesce(has_thalweg_mean,0)<0.10 and coalesce(surface_m2,300)>150)::int h1,
      (coalesce(slope_p90,12)>25 or coalesce(has_thalweg_mean,0)>0.30 or coalesce(slope_std,6)>15)::int h2,
      coalesce(median_price>p80,false)::int h3, coalesce(median_price<p20,false)::int h4,
      coalesce(cluster_score>80,false)::int h5_pos, coalesce(cluster_score<20,false)::int h5_neg
      from features f left join price p on p.sale_id=cast(f.parcel_id as varchar) cross join priceq""",
    "voted": """select *, case when p>=n and p>=0.35 then 1 when n>p and n>=0.35 then 0 else -1 end proxy_label,
      case when p2>=n2 and p2>=0.35 then 1 when n2>p2 and n2>=0.35 then 0 else -1 end label_without_clusters from (
      select *, h1*0.40::double+h3*0.45::double+h5_pos*0.15::double p, h2*0.75::double+h4*0.20::double+h5_neg*0.05::double n,
      h1*0.50::double+h3*0.50::double p2, h2*0.75::double+h4*0.25::double n2 from votes)""",
    "scored0": f"""select f.*, {ladder('CPI_valeur', K.LADDER_VALUE)} CPI_valeur_label, v.proxy_label, m.CPI_ML_v3, m.cpi_ml_std, m.cpi_ml_ci_low, m.cpi_ml_ci_high,
      mk.CPI_market, pf.CPI_preference from final1 f left join voted v on f.parcel_id=v.parcel_id left join fx_ml m on f.parcel_id=m.parcel_id
      left join fx_market mk on rpad(replace(replace(upper(trim(mk.id_parcelle)),' ',''),'-',''),14,' ')=rpad('73065AB'||f.parcel_id,14,' ')
      left join fx_preference pf on pf.id_parcelle_norm='73065AB'||f.parcel_id""",
    "ranked": "select parcel_id, " + ", ".join(f"{pct_rank(c)} r_{c}" for c in CONSENSUS) + " from scored0",
    "merged": """select parcel_id, list_avg(l) consensus_score, 1.0::double-coalesce(list_stddev_samp(l),0)/100.0::double confidence0, len(l) n_approaches_used from (
      select parcel_id, list_filter([r_CPI_v3,r_cluster_score,r_CPI_market,r_CPI_preference], lambda x: x is not null) l from ranked)""",
    "scored": """select s.*, m.consensus_score, least(greatest(m.confidence0,0),1) consensus_confidence, m.n_approaches_used, m.confidence0
      from scored0 s left join merged m on s.parcel_id=m.parcel_id""",
    "imputed": "select * replace (" + ", ".join(f"coalesce({c}, (select coalesce(quantile_cont({c},0.5),0) from scored)) as {c}" for c in FEATURES) + ") from scored",
    "shap0": "select * from imputed where is_valid and proxy_label<>-1",
    "shap": "select parcel_id, " + ", ".join(f"({c}-avg({c}) over ())*{w}::double shap_{c}" for c, w in WEIGHTS.items()) + " from shap0",
    "rzones": """select k zone_id, c0, r0, 3+k%5 w, 3+k%7 h, 925000.0::double+c0*0.5::double xmin, 6505000.0::double-(r0+3+k%7)*0.5::double ymin,
      925000.0::double+(c0+3+k%5)*0.5::double xmax, 6505000.0::double-r0*0.5::double ymax
      from (select p_partkey k, (p_partkey*7)%46 c0, (p_partkey*3)//20 r0 from part)""",
    "members": "select zone_id, r, c, z from rzones join fx_cells on c>=c0 and c<c0+w and r>=r0 and r<r0+h",
    "stencil0": STENCIL,
    "stencil": """select *, case when has_n then lag(w) over wc else w end nw, case when has_n then lag(z) over wc else z end n,
      case when has_n then lag(e) over wc else e end ne, case when has_s then lead(w) over wc else w end sw,
      case when has_s then lead(z) over wc else z end s, case when has_s then lead(e) over wc else e end se
      from (select *, coalesce(lag(r) over w2 = r-1, false) has_n, coalesce(lead(r) over w2 = r+1, false) has_s from stencil0 window w2 as (partition by c order by r))
      window wc as (partition by c order by r)""",
    "slopes": """select r, c, z, case when z is not null then degrees(atan(sqrt(power(((ne+2*e+se)-(nw+2*w+sw))/(8*0.5::double),2)+power(((sw+2*s+se)-(nw+2*n+ne))/(8*0.5::double),2)))) end slope_deg from stencil""",
    "flat": """select r, c, case when slope_deg is not null then (slope_deg<=7)::int end flat from (
      select r, c, case when z is not null then degrees(atan(sqrt(power(((ne+2*e+se)-(nw+2*w+sw))/(8*50.0::double),2)+power(((sw+2*s+se)-(nw+2*n+ne))/(8*50.0::double),2)))) end slope_deg from stencil)""",
    "grads": """select r, c, z, case when has_w and has_e then (e-w)/(2*0.5::double) when has_e then (e-z)/0.5::double when has_w then (z-w)/0.5::double end dx,
      case when has_n and has_s then (s-n)/(2*0.5::double) when has_s then (s-z)/0.5::double when has_n then (z-n)/0.5::double end dy from stencil""",
    "ranking": """select parcel_id, block_id, proxy_label as label, CPI_v3 score, cast(parcel_id%5 as int) fold, (CPI_v3>=45)::int predicted, CPI_ML_v3 from scored where is_valid and proxy_label<>-1""",
    "clustered": "select *, cast(parcel_id%4 as int) cluster_id from scored where is_valid",
    "profile": "select cluster_id, " + ", ".join(f"median({c}) {c}" for c in PROFILE) + ", avg(nullif(proxy_label,-1)) label_rate from clustered group by cluster_id",
    "construct": "select cluster_id, (" + "+".join(
        (f"(1.0::double-{e})" if c in K.CLUSTER_LOWER_IS_BETTER else e)
        for c in PROFILE
        for e in [f"coalesce(({c}-min({c}) over ())/nullif(max({c}) over ()-min({c}) over (),0), 0.5::double)"]
    ) + f")/{len(PROFILE)}.0::double constructibility_score from profile",
    "ends": """select (select cluster_id from construct order by constructibility_score desc, cluster_id limit 1) best,
      (select cluster_id from construct order by constructibility_score asc, cluster_id desc limit 1) worst""",
    "screened": f"""select *, {ladder('CPI_technique', K.LADDER_VIEWER, K.LABEL_MISSING)} cat from scored where CPI_technique>=30 and consensus_confidence>=0.5
      and slope_p90<=30 and surface_m2>=100 and is_valid""",
    "tau_valid": "select * from validated where is_valid",
    "tau_scaling": stats("tau_valid", FEATURES),
    "tau_groups": "select parcel_id, "
    + f"({norm('slope_p50', True)}*0.40::double+{norm('slope_p90', True)}*0.35::double+{norm('slope_std', True)}*0.25::double)*100.0::double p, "
    + f"{norm('twi_mean', True)}*100.0::double h, ({norm('profile_curvature_mean')}*0.55::double+{norm('tri_mean', True)}*0.45::double)*100.0::double m, "
    + f"{sun()}*100.0::double s from tau_valid cross join tau_scaling",
}
# steepest drop among eight neighbours: diagonals are sqrt(2) away, ties go to reading order
_STEP = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
# least surface above the ground on which every cell with eight known neighbours drains, by flooding from the other cells
CTE["cell_links"] = """select a.r, a.c, b.r r2, b.c c2 from fx_cells a cross join (select unnest(range(-1, 2)) i) cross join (select unnest(range(-1, 2)) j)
  join fx_cells b on b.r=a.r+i and b.c=a.c+j where a.z is not null and b.z is not null and (i<>0 or j<>0)"""
CTE["inner_cells"] = "select r, c from cell_links group by r, c having count(*)=8"
CTE["flood"] = """select 0 step, a.r, a.c, z, i.r is not null inside, case when i.r is null then z else 'inf'::double end w, true moved
    from fx_cells a left join inner_cells i on i.r=a.r and i.c=a.c where z is not null
  union all select step+1, r, c, z, inside, v, v<w from (
    select f.step, f.r, f.c, f.z, f.inside, f.w, case when f.inside then greatest(f.z, least(f.w, m.low+1e-4::double)) else f.w end v
    from flood f left join (select x.r, x.c, min(g.w) low from cell_links x join flood g on g.r=x.r2 and g.c=x.c2 group by x.r, x.c) m on m.r=f.r and m.c=f.c
    where exists (select 1 from flood where moved))"""
CTE["filled_cells"] = "select r, c, w from flood where step=(select max(step) from flood)"
_offsets = ", ".join(f"({i},{dr},{dc},{math.hypot(dr, dc)!r}::double)" for i, (dr, dc) in enumerate(_STEP.values()))
CTE["filled_drops"] = f"""select a.r, a.c, (a.r+dr)*100000+(a.c+dc) dest, i, (a.w-b.w)/h d from filled_cells a cross join (values {_offsets}) o(i,dr,dc,h)
  join filled_cells b on b.r=a.r+dr and b.c=a.c+dc where a.w>b.w"""
CTE["filled_pointers"] = """select f.r, f.c, f.z, f.r*100000+f.c k, p.dest from fx_cells f
  left join (select r, c, arg_min(dest, i) dest from (select *, max(d) over (partition by r, c) steepest from filled_drops) where d=steepest group by r, c) p on p.r=f.r and p.c=f.c"""
CTE["filled_walk"] = "select k s, k cur from filled_pointers where z is not null union all select w.s, p.dest from filled_walk w join filled_pointers p on w.cur=p.k where p.dest is not null"
CTE["acc"] = "select p.r, p.c, p.z, case when p.z is not null then a.n end accumulation from filled_pointers p left join (select cur, count(*) n from filled_walk group by cur) a on a.cur=p.k"
_given_runs = "select run, parcel_id, ((parcel_id*31+run*run*17+run*7)%1009)/1009.0::double*least(slope_p50,30)+40.0::double p from features cross join (select unnest(range(40)) run)"
CTE["runs"] = _given_runs
CTE["intervals"] = "select parcel_id, avg(p) cpi_ml_mean, stddev_pop(p) cpi_ml_std, quantile_cont(p,0.025) cpi_ml_ci_low, quantile_cont(p,0.975) cpi_ml_ci_high from runs group by parcel_id"
CTE["topfold"] = "select *, row_number() over (partition by fold order by score desc, parcel_id) rn, row_number() over (partition by fold order by label desc, parcel_id) rl from ranking"
# folds: largest block first, each to the first of the lightest folds
CTE["sized"] = "select block_id, n, row_number() over (order by n desc, block_id) i from (select block_id, count(*) n from scored where is_valid and proxy_label<>-1 group by block_id)"
CTE["packed"] = """select 0::bigint i, [0,0,0,0,0]::bigint[] loads, -1::bigint fold, ''::varchar block_id union all
  select z.i, list_concat(list_concat(loads[1:f-1], [loads[f]+z.n]), loads[f+1:]), f-1, z.block_id
  from (select *, list_position(loads, list_min(loads)) f from packed) k join sized z on z.i=k.i+1"""
# bisection for tau
_mix = f"((p+h+m+s)/4.0::double)*0.70::double+{softmin(['p', 'h', 'm', 's'], '((lo+hi)/2)')}*0.30::double"
for _n, _target in (("bis14", 14.3), ("bis18", 18.0)):
    CTE[_n] = f"""select 0 i, 0.5::double lo, 100.0::double hi union all select i+1,
      case when sd<{_target} then lo else (lo+hi)/2 end, case when sd<{_target} then (lo+hi)/2 else hi end
      from (select i, lo, hi, stddev_pop({_mix}) sd from {_n} cross join tau_groups where i<50 group by i, lo, hi)"""
CTE["tau_of"] = "select (lo+hi)/2 tau_v from bis18 where i=50"
# the score chain once more, with the calibrated tau
CTE["raw0_t"] = CTE["raw0"].replace("/10.0::double)", "/tau_v::double)") + " cross join tau_of"
CTE["raw1_t"] = CTE["raw1"].replace("raw0", "raw0_t")
CTE["gated_t"] = CTE["gated"].replace("raw1", "raw1_t")
CTE["final0_t"] = CTE["final0"].replace("/10.0::double)", "/tau_v::double)").replace("gated", "gated_t")
CTE["comp"] = "select r, c, r*2147483648::bigint+c k from flat where flat=1"
CTE["reach"] = """select k root, r, c from comp union select h.root, x.r, x.c from reach h cross join (values (0,1),(0,-1),(1,0),(-1,0)) o(dr,dc)
  join comp x on x.r=h.r+o.dr and x.c=h.c+o.dc"""
RECURSIVE = {"flood", "filled_walk", "packed", "bis14", "bis18", "reach"}
KEPT = {"cell_links", "inner_cells", "filled_cells", "filled_pointers"}  # read in every round of a recursion
_order = list(CTE)
ORACLE: dict[str, str] = {}


def _needs(sql: str, seen: set[str]) -> set[str]:
    for name in _order:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            seen.add(name)
            _needs(CTE[name], seen)
    return seen


def put(name: str, sql: str) -> None:
    used = _needs(sql, set())
    # a later table may not precede an earlier one that it reads
    done: list[str] = []

    def visit(n: str) -> None:
        for m in _needs(CTE[n], set()):
            if m != n and m not in done:
                visit(m)
        if n not in done:
            done.append(n)

    for n in used:
        visit(n)
    recursive = "recursive " if RECURSIVE.intersection(done) else ""
    prefix = ", ".join(f"{n} as {'materialized ' if n in KEPT else ''}({CTE[n]})" for n in done)
    ORACLE[name] = f"with {recursive}{prefix} {sql}" if prefix else sql


# --- sources and sinks ---------------------------------------------------------------------------------
_SALE = "id_parcelle, " + R("valeur_fonciere") + ", " + R("surface_terrain") + ", nature_mutation, code_commune"
put("scan_csv", f"select {_SALE} from fx_sales")
_LONLAT = "select p_partkey id, 5.9::double+(p_partkey%100)/1000.0::double lon, 45.5::double+(p_partkey%77)/1000.0::double lat from part"
put("scan_csv_dialect", f"select {RS('lon', 'lat')} from ({_LONLAT})")
put("scan_csv_gz", f"select {_SALE} from fx_sales where code_commune='73065' or not exists (select 1 from fx_sales where code_commune='73065')")
put("scan_geojson", f"select cast(parcel_id as varchar) id, {R('area_m2')} from shape")


def lambert(source: str) -> str:
    p = LAMBERT93
    es = f"({p['e']!r}::double*sin(radians(lat)))"
    t = f"(tan(pi()/4-radians(lat)/2)/power((1-{es})/(1+{es}), {p['e'] / 2!r}::double))"
    rho = f"({p['c']!r}::double*power({t}, {p['n']!r}::double))"
    th = f"({p['n']!r}::double*(radians(lon)-{p['lon0']!r}::double))"
    mm = lambda e: f"round_even(({e})*1000.0::double,0)/1000.0::double"
    x, y = f"{p['x0']!r}::double+{rho}*sin({th})", f"{p['y0'] + p['rho0']!r}::double-{rho}*cos({th})"
    return f"select id, {R(mm(x), 'x')}, {R(mm(y), 'y')} from ({source})"


put("scan_points", lambert(_LONLAT))
put("scan_raster_cells", f"select r, c, {R('z')}, 't' || (r//100) tile_id from fx_cells")
put("stage_snapshot", f"select p.parcel_id, {R('slope_p90')}, {R('twi_mean')}, f.block_id from fx_parcels p left join features f on p.parcel_id=f.parcel_id")
put("sink_csv", f"select parcel_id, {RS('CPI_v3')}, gate_reason, shape_warning, {RS('cluster_score')} from scored")
put("sink_report_json", f"""select count(*) n_total, count(*) filter (where is_valid) n_valid, count(*) filter (where is_valid and proxy_label<>-1) n_labeled,
  count(*) filter (where is_valid and proxy_label=1) n_pos, count(*) filter (where is_valid and proxy_label=0) n_neg, count(distinct block_id) n_blocks,
  {R('avg(CPI_v3) filter (where is_valid)', 'cpi_mean')}, {R('stddev_samp(CPI_v3) filter (where is_valid)', 'cpi_std')},
  {R('median(compactness_ratio)', 'median_compactness')}, count(*) filter (where emprise_residuelle_m2>=80) n_viable_80m2, 10.0::double tau_softmin from scored""")
put("unify_sources", f"""select {R("case when k=2 and false then null else valeur_fonciere end", 'valeur_fonciere')},
  {R('case when k<>2 then surface_terrain end', 'surface_terrain')}, id_parcelle, case when k<>2 then nature_mutation end nature_mutation,
  case when k<>2 then code_commune end code_commune from (select *, cast(id_parcelle as bigint)%3 k from fx_sales)""")

# --- cleaning --------------------------------------------------------------------------------------------
put("coerce_numeric", f"select l_partkey, {R('case when l_linenumber in (3,4) then null else l_quantity end', 'surface')} from lineitem")
put("filter_sales", f"select {_SALE} from fx_sales where contains(nature_mutation,'Vente') and surface_terrain<>13")
put("price_per_m2", f"""select {_SALE}, {R('valeur_fonciere/surface_terrain', 'prix_m2')} from fx_sales where valeur_fonciere>0 and surface_terrain>0
  and valeur_fonciere/surface_terrain between 10 and 10000""")
put("commune_filter_fallback", f"select id_parcelle, {RS('prix_m2')}, code_commune from sales")
put("commune_from_id", "select '7306'||id_parcelle id_parcelle, substr('7306'||id_parcelle,1,5) commune_code from fx_sales")
put("valid_geometry", "select parcel_id from fx_parcels where parcel_id%10 not in (0,1,2)")
put("nan_ratio", f"select parcel_id, {RS('nan_ratio')} from validated")
put("is_valid", "select parcel_id, is_valid from validated")
put("filter_counters", """select count(*) n_total, count(*) filter (where is_valid) n_valid, count(*) filter (where nan_ratio>0.40) n_too_null,
  count(*) filter (where surface_m2>5000) n_too_big, count(*) filter (where surface_m2<20) n_too_small,
  count(*) filter (where zone_plu not in ('U','AU','UB','UC','UD','UE','UF','AUB','inconnu')) n_bad_zone from validated""")
put("median_impute", "select parcel_id, " + ", ".join(R(f"coalesce({c}, (select quantile_cont({c},0.5) from features))", c) for c in FEATURES) + " from features")
put("default_fill", "select parcel_id, " + ", ".join(R(f"coalesce(case when parcel_id%9<>{i} then {c} end, {v})", c) for i, (c, v) in enumerate(K.LABEL_DEFAULTS.items())) + " from features")
_ID = "replace(replace(upper(trim(id_parcelle)),' ',''),'-','')"
put("normalize_parcel_id", f"select id_parcelle, rpad({_ID},14,' ') id_padded, {_ID} id_compact, upper(trim(id_parcelle)) id_sale from fx_market")
_Z = "replace(upper(trim(typezone)),' ','')"
_ZN = f"case when typezone is null then 'inconnu' when {_Z} like 'AU%' or {_Z} like 'U%' then {_Z} when {_Z} like 'N%' then 'N' when {_Z} like 'A%' then 'A' else 'inconnu' end"
put("normalize_zone", f"select zone_id, {_ZN} zone_norm from fx_zones")
put("bbox_filter", f"select parcel_id, {RS('xmin', 'ymin', 'xmax', 'ymax')} from fx_parcels where xmax>=926000 and xmin<=927500 and ymax>=6500000 and ymin<=6502000")
_fam = []
for _name, _cols in K.FAMILY_COLUMNS.items():
    _sum = "+".join(f"count({c})" for c in _cols)
    _fam.append(f"select {q(_name)} family, " + ("false available" if "svf_mean" in _cols or _name == "tri" else f"({_sum})>0 available from features"))
put("feature_availability", " union all ".join(_fam))
put("drop_all_null", f"select parcel_id, {RS('cluster_score', 'CPI_ML_v3', 'CPI_market', 'CPI_preference')} from scored where coalesce(cluster_score,CPI_ML_v3,CPI_market,CPI_preference) is not null")
_TEXT = {"commune", "is_valid", "proxy_label", "block_id", "CPI_v3_label", "CPI_technique_label", "gate_reason", "zone_plu", "shape_warning", "ces_warning", "n_approaches_used", "CPI_valeur_label"}
_EXPORT = [*K.EXPORT_META, *FEATURES, *K.EXPORT_SCORES, "brgm_argiles_flag", "brgm_mvt_terrain_flag", *K.EXPORT_VALUE]
put("export_projection", "select parcel_id, " + ", ".join(c if c in _TEXT or c.startswith("brgm") else R(c) for c in _EXPORT) + " from scored")
put("ml_dataset", f"select parcel_id, block_id, {RS(*FEATURES)}, proxy_label, {RS('CPI_v3')} from scored where is_valid and proxy_label<>-1")
put("parcel_id_coalesce", "select parcel_id, case when parcel_id%3=0 then 'P'||parcel_id when parcel_id%5=0 then 'G'||parcel_id else cast(parcel_id as varchar) end parcel_key from fx_parcels")

# --- joins ---------------------------------------------------------------------------------------------
_TOUCH = "p.xmin<=z.xmax and z.xmin<=p.xmax and p.ymin<=z.ymax and z.ymin<=p.ymax"
put("spatial_left_join", f"select p.parcel_id, z.zone_id, z.typezone from fx_parcels p left join fx_zones z on {_TOUCH}")
put("zone_assign", f"""select parcel_id, coalesce(arg_min(zn, rk||zn), 'inconnu') zone_plu from (
  select parcel_id, zn, case when zn like 'AU%' then '0' when zn like 'U%' then '1' when zn like 'N%' then '2' when zn like 'A%' then '3' else '4' end rk from (
  select p.parcel_id, case when z.zone_id is not null then {_ZN} end zn from fx_parcels p left join fx_zones z on {_TOUCH})) group by parcel_id""")
put("hazard_flag", "select * from flags")
put("overlay_built_area", f"select parcel_id, {RS('built_area')} from built")
put("price_lookup", f"select f.parcel_id, {RS('median_price')} from features f left join price p on p.sale_id=cast(f.parcel_id as varchar)")
put("align_scores", f"select p.parcel_id, {RS('CPI_ML_v3')} from fx_parcels p left join fx_ml m on p.parcel_id=m.parcel_id")
put("attach_features", f"select parcel_id, {RS('slope_p50', 'compactness_ratio', 'ces_existant')}, brgm_argiles_flag, block_id from features")
put("score_align_concat", f"select p.parcel_id, {RS(*CONSENSUS)} from fx_parcels p left join scored s on p.parcel_id=s.parcel_id")
put("external_score_map", f"select parcel_id, {RS('CPI_market', 'CPI_preference')} from scored0")
put("ci_enrich", f"select s.parcel_id, {RS('shap_slope_p90', 'cpi_ml_ci_low', 'cpi_ml_ci_high', 'cpi_ml_std')} from shap s left join fx_ml m on s.parcel_id=m.parcel_id")
put("geometry_join", f"select s.parcel_id, {RS('CPI_technique', 'surface_m2', 'xmin', 'ymin', 'xmax', 'ymax')} from screened s join fx_parcels p on s.parcel_id=p.parcel_id")
put("semi_join_ids", f"select parcel_id, {RS('slope_p90')} from fx_features where parcel_id in (select parcel_id from shap)")
_T = "least(greatest(((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1),0),0),1)"
put("nearest_road_distance", f"""select parcel_id, {R(f'min(sqrt(power(px-(x1+{_T}*(x2-x1)),2)+power(py-(y1+{_T}*(y2-y1)),2)))', 'dist_road_m')}
  from (select parcel_id, (xmin+xmax)/2 px, (ymin+ymax)/2 py from fx_parcels) cross join fx_roads group by parcel_id""")
put("cell_in_polygon_join", "select zone_id, r, c from members")
_X, _Y = "(925000.0::double+(c+0.5)*0.5)", "(6505000.0::double-(r+0.5)*0.5)"
put("buffer_zonal", f"""select z.zone_id, {R('max(z)', 'height_obj_max')}, {R('avg(z)', 'height_obj_mean')} from rzones z left join fx_cells
  on sqrt(power(greatest(xmin-{_X},0,{_X}-xmax),2)+power(greatest(ymin-{_Y},0,{_Y}-ymax),2))<=20 group by z.zone_id""")
_CMP = ["CPI_technique", "CPI_ML_v3", "cluster_score", "consensus_score", "consensus_confidence"]
put("compare_pairs", "select a.parcel_id id_a, b.parcel_id id_b, " + ", ".join(R(f"a.{c}-b.{c}", f"delta_{c}") for c in _CMP)
    + f", case when a.CPI_technique>b.CPI_technique then a.parcel_id else b.parcel_id end winner, {R('abs(a.CPI_technique-b.CPI_technique)', 'margin')} from scored a join scored b on b.parcel_id=a.parcel_id+1 join part on p_partkey=a.parcel_id")

# --- geometry --------------------------------------------------------------------------------------------
for _name, _cols in {"geom_area": ["area_m2"], "geom_perimeter": ["perimeter_m"], "geom_centroid": ["cx", "cy"], "compactness": ["compactness_ratio"], "elongation": ["elongation_ratio"]}.items():
    put(_name, f"select parcel_id, {RS(*_cols)} from shape")
put("block_id", "select parcel_id, block_id from shape")
put("geom_bounds", f"select parcel_id, {RS('xmin', 'ymin', 'xmax', 'ymax')} from fx_parcels")
put("to_lambert93", lambert("select o_orderkey id, (o_orderkey%1000)/100.0::double-2.0 lon, 42.0::double+(o_orderkey%877)/100.0::double lat from orders"))

# --- raster ------------------------------------------------------------------------------------------------
put("mosaic", f"select r, c, {R('case when (r+c)%7<>0 then z when r%2=0 then z+1000 end', 'z')} from fx_cells")
put("raster_profile", """select min(r) r_min, max(r) r_max, min(c) c_min, max(c) c_max, count(*) n_cells, count(*)-count(z) n_nodata, max(r)-min(r)+1 n_rows,
  max(c)-min(c)+1 n_cols, true res_ok, (max(r)-min(r)+1)*(max(c)-min(c)+1)=count(*) dense from fx_cells""")
put("slope_horn", f"select r, c, {RS('slope_deg')} from slopes")
put("tri_riley", f"select r, c, {R('sqrt(' + '+'.join(f'power({k}-z,2)' for k in _STEP) + ')', 'tri')} from stencil")
_zen = math.pi / 2 - math.radians(90.0 - K.SUN_LATITUDE_DEG + K.SUN_DECLINATION_DEG)
_tilt = "atan(sqrt(dx*dx+dy*dy))"
_hs = f"({math.cos(_zen)!r}::double*cos({_tilt})+{math.sin(_zen)!r}::double*sin({_tilt})*cos(atan2(-dy,dx)-pi()))"
put("hillshade_winter", f"select r, c, {R(f'case when z is null or {_hs} is null then null else least(greatest({_hs},0),1) end', 'hillshade')} from grads")
_ang = "degrees(atan2(-dy,dx))"
put("aspect_south", f"select r, c, case when z is null then null else coalesce((case when {_ang}<0 then {_ang}+360 else {_ang} end) between 135 and 225, false)::int end aspect_south from grads")
put("curvature_laplacian", f"""select a.r, a.c, {R('case when a.z is not null then avg(b.lap) end', 'curvature')} from fx_cells a
  cross join (select unnest(range(-2,3)) i) cross join (select unnest(range(-2,3)) j) cross join (select max(r) mr, max(c) mc from fx_cells)
  join (select r, c, (n+s+w+e-4*f)/0.25::double lap from (select *, coalesce(lag(f) over wc, f) n, coalesce(lead(f) over wc, f) s, coalesce(lag(f) over wr, f) w, coalesce(lead(f) over wr, f) e
    from (select r, c, coalesce(z, (select median(z) from fx_cells)) f from fx_cells) window wr as (partition by r order by c), wc as (partition by c order by r))) b
  on b.r=(case when a.r+i<0 then -1-(a.r+i) when a.r+i>mr then 2*mr+1-(a.r+i) else a.r+i end) and b.c=(case when a.c+j<0 then -1-(a.c+j) when a.c+j>mc then 2*mc+1-(a.c+j) else a.c+j end)
  group by a.r, a.c, a.z""")
put("flat_mask", "select r, c, flat from flat")
put("fill_depressions", f"select a.r, a.c, {R('a.z', 'z')}, {R('w', 'filled')} from fx_cells a left join filled_cells f on f.r=a.r and f.c=a.c")
for _name in ("flow_accumulation_d8", "flow_accumulation_d8_filled"):
    put(_name, "select r, c, accumulation from acc")
for _name in ("twi", "twi_filled"):
    put(_name, f"""select s.r, s.c, {R('case when slope_deg is not null and accumulation is not null then least(20, ln(greatest(accumulation*0.25::double,0.25)/tan(greatest(radians(slope_deg),radians(0.5))))) end', 'twi')}
  from slopes s join acc a on s.r=a.r and s.c=a.c""")
for _name in ("thalweg_mask", "thalweg_mask_filled"):
    put(_name, "select r, c, case when z is not null then (accumulation>=500)::int end thalweg from acc")
_offs = ", ".join(f"({d},{dr},{dc},{math.hypot(dr, dc) * 50.0!r}::double)" for d, line in enumerate(sky_offsets()) for dr, dc in line)
put("sky_view_factor", f"""select r, c, {R('case when z is not null then 1-avg(sn) end', 'svf')} from (
  select a.r, a.c, a.z, o.d, sin(atan(greatest(0, coalesce(max((b.z-a.z)/o.dist),0)))) sn from fx_cells a cross join (values {_offs}) o(d,dr,dc,dist)
  left join fx_cells b on b.r=a.r+o.dr and b.c=a.c+o.dc group by a.r, a.c, a.z, o.d) group by r, c, z""")
put("raster_summary", f"select {R('avg(flat)', 'mean_value')}, {R('min(flat)::double', 'min_value')}, count(*) filter (where flat=1) n_ones, {R('count(*) filter (where flat=1)/count(*)::double', 'share_ones')} from flat")

# --- zonal and aggregates ------------------------------------------------------------------------------------
put("zonal_stats", f"""select k.zone_id, {R('avg(z)', 'z_mean')}, {R('max(z)', 'z_max')}, {R('min(z)', 'z_min')}, {R('stddev_pop(z)', 'z_std')},
  case when count(m.zone_id)>0 then count(z) end z_count from rzones k left join members m on k.zone_id=m.zone_id group by k.zone_id""")
put("zonal_percentiles", f"select k.zone_id, {R('quantile_cont(z,0.5)', 'z_p50')}, {R('quantile_cont(z,0.9)', 'z_p90')}, {R('stddev_pop(z)', 'z_std')} from rzones k left join members m on k.zone_id=m.zone_id group by k.zone_id")
put("zonal_lineitem", f"""select l_partkey, {R('quantile_cont(l_extendedprice,0.5)', 'price_p50')}, {R('quantile_cont(l_extendedprice,0.9)', 'price_p90')}, {R('avg(l_quantity)', 'qty_mean')},
  {R('max(l_quantity)', 'qty_max')}, {R('min(l_quantity)', 'qty_min')}, {R('stddev_pop(l_quantity)', 'qty_std')}, count(l_quantity) qty_count from lineitem group by 1""")
put("flat_area", f"""select k.zone_id, {R('avg(flat)', 'flat_area_ratio')}, {R('any_value(k.w*0.5*k.h*0.5)*avg(flat)', 'max_flat_area_m2')} from rzones k left join flat f
  on f.c>=k.c0 and f.c<k.c0+k.w and f.r>=k.r0 and f.r<k.r0+k.h group by k.zone_id""")
put("ces_residual", f"select parcel_id, {RS('ces_existant', 'ces_residuel', 'emprise_residuelle_m2')} from ces")
put("group_median_price", f"select sale_id, {RS('median_price')} from price")
put("price_quantiles", f"select n_sales, {R('p20')}, {R('med', 'median')}, {R('p80')} from priceq")
_BAL = "(select block_id, sum(proxy_label)::bigint n_pos, count(*) n, sum(proxy_label)/count(*)::double ratio from scored where proxy_label<>-1 group by block_id)"
put("block_balance", f"select block_id, n_pos, n, {R('ratio')} from {_BAL}")
put("block_classes", f"""select *, pure_pos+pure_neg>total*0.3 many_pure from (select count(*) filter (where ratio>=0.10::double and ratio<=0.90::double) mixed, count(*) filter (where ratio>0.90::double) pure_pos,
  count(*) filter (where ratio<0.10::double) pure_neg, count(*) total from {_BAL})""")
put("distinct_blocks", "select count(distinct block_id) n_blocks from shape")
put("score_summary", " union all ".join(
    f"select {q(s)} score, {R(f'avg({s})', 'score_mean')}, {R(f'stddev_samp({s})', 'score_std')}, {R(f'min({s})', 'score_min')}, {R(f'max({s})', 'score_max')} from scored where is_valid" for s in ("CPI_v3", "CPI_technique")))
put("zone_distribution", """select 'U' zone, count(*) filter (where zone_plu like 'U%') n from features union all select 'AU', count(*) filter (where zone_plu like 'AU%') from features
  union all select 'N', count(*) filter (where zone_plu='N') from features union all select 'A', count(*) filter (where zone_plu='A') from features
  union all select 'inconnu', count(*) filter (where zone_plu='inconnu') from features""")
_LZ = "(select replace(upper(trim(coalesce(typezone, case when zone_id%2=0 then ' au x' end, ''))),' ','') v from fx_zones)"
put("layer_zone_counts", f"""select 'U' zone, count(*) filter (where v like 'U%') n from {_LZ} union all select 'AU', count(*) filter (where v like 'AU%') from {_LZ}
  union all select 'N', count(*) filter (where v like 'N%') from {_LZ} union all select 'A', count(*) filter (where v like 'A%' and v not like 'AU%') from {_LZ}""")
put("shape_ces_metrics", f"""select count(*) filter (where compactness_ratio<0.20) n_elongated, count(*) filter (where emprise_residuelle_m2>=80) n_viable_80m2,
  count(*) filter (where ces_existant>0.80) n_saturated, count(*) filter (where brgm_argiles_flag) n_brgm_argiles_flag, count(*) filter (where brgm_mvt_terrain_flag) n_brgm_mvt_terrain_flag,
  {R('median(compactness_ratio)', 'median_compactness')}, {R('median(ces_residuel)', 'median_residuel')} from scored""")
put("label_distribution", " union all ".join(
    f"select {i} as position, {q(l)} as label, count(*) filter (where {s}_label={q(l)}) n, {R(f'count(*) filter (where {s}_label={q(l)})*100.0::double/count(*)', 'pct')}, {q(s)} score from scored"
    for s, lad in (("CPI_v3", K.LADDER_FINAL), ("CPI_technique", K.LADDER_TECHNICAL)) for i, (_, l) in enumerate(lad)))
_C = ["CPI_v3", "CPI_technique", "consensus_score", "cluster_score", "CPI_ML_v3"]
put("corr_matrix", " union all ".join(f"select {q(a)} score_a, {q(b)} score_b, round_even(corr({a},{b})*1000.0::double,0)/1000.0::double pearson from scored" for i, a in enumerate(_C) for b in _C[i + 1:]))
_RK = "(rank() over (partition by zone_plu order by {0}) + (count(*) over (partition by zone_plu, {0}) - 1)/2.0::double)"
put("spearman", f"select zone_plu, {R('corr(ra,rb)', 'spearman')} from (select zone_plu, {_RK.format('CPI_v3')} ra, {_RK.format('CPI_ML_v3')} rb from scored where CPI_v3 is not null and CPI_ML_v3 is not null) group by zone_plu")
put("score_gap", f"""select count(*) n_common, {R('avg(abs(CPI_ML_v3-CPI_v3))', 'mean_gap')}, {R('max(abs(CPI_ML_v3-CPI_v3))', 'max_gap')}, {R('corr(CPI_v3,CPI_ML_v3)', 'pearson')} from scored where CPI_ML_v3 is not null""")
put("confusion_matrix", f"""select *, {R('tp/(tp+fp+1e-9::double)', 'precision')}, {R('tp/(tp+fn+1e-9::double)', 'recall')} from (
  select trunc(avg(tn))::bigint tn, trunc(avg(fp))::bigint fp, trunc(avg(fn))::bigint fn, trunc(avg(tp))::bigint tp from (
  select fold, count(*) filter (where label=0 and predicted=0) tn, count(*) filter (where label=0 and predicted=1) fp, count(*) filter (where label=1 and predicted=0) fn,
  count(*) filter (where label=1 and predicted=1) tp from ranking group by fold))""")
_GROUP = {f: g for g, fs in K.FEATURE_GROUPS.items() for f in fs}
_IMP = " union all ".join(f"select {q(f)} feature, {q(_GROUP[f])} groupe, avg(abs(shap_{f})) v from shap" for f in FEATURES)
put("shap_importance", f"select feature, groupe, {R('v', 'mean_abs_shap')} from ({_IMP})")
put("shap_group_importance", f"select groupe, {R('sum(v)', 'mean_abs_shap')} from ({_IMP}) group by groupe")
put("histogram", " union all ".join(
    f"""select bin, count(*) n, {q(s)} score from (select 1+len(list_filter(range(1, 20), lambda k: {s} >= lo + k*(hi-lo)/20.0::double))::int bin
      from scored cross join (select min({s})::double lo, max({s})::double hi from scored) where {s} is not null) group by bin"""
    for s in ("CPI_technique", "cpi_ml_std")))
put("cluster_profile", f"select cluster_id, {RS(*PROFILE, 'label_rate')} from profile")

# --- scoring ---------------------------------------------------------------------------------------------
_RAWQ = "(select quantile_cont(slope_p50,0.01) s_lo, quantile_cont(slope_p50,0.99) s_hi, quantile_cont(twi_mean,0.01) t_lo, quantile_cont(twi_mean,0.99) t_hi, quantile_cont(slope_p90,0.01) p_lo, quantile_cont(slope_p90,0.99) p_hi from features)"
put("robust_normalize", f"""select parcel_id, {R(norm('slope_p50', lo='s_lo', hi='s_hi', fill='s_lo'), 'slope_norm')}, {R(norm('twi_mean', True, lo='t_lo', hi='t_hi', fill='t_lo'), 'twi_inverted')},
  0.5::double constant_norm from features cross join {_RAWQ}""")
put("sigmoid_stretch", f"""select parcel_id, {R(norm('slope_p90', False, True, 'p_lo', 'p_hi', 'p_lo'), 'slope_stretch')}, {R(norm('twi_mean', True, True, 't_lo', 't_hi', 't_lo'), 'twi_stretch')}
  from features cross join {_RAWQ}""")
put("group_scores", f"select parcel_id, {RS(*G4)} from grouped")
put("group_scores_no_svf", f"select parcel_id, {R(h1(sun(False) + '*100.0::double'), 'score_soleil')} from validated cross join scaling")
put("tau_group_scores", f"select parcel_id, {RS('p', 'h', 'm', 's')} from tau_groups")
put("softmin", "select parcel_id, " + ", ".join(R(softmin(list(G4), t), f"softmin_{n}") for n, t in (("small", "0.5"), ("mid", "10.0"), ("large", "100.0"))) + " from scored")
_MIX = f"((p+h+m+s)/4.0::double)*0.70::double+{softmin(['p', 'h', 'm', 's'], 'tau')}*0.30::double"
put("calibrate_tau_curve", f"select tau, {R(f'stddev_pop({_MIX})', 'score_std')} from tau_groups cross join (select unnest([0.5,1,2,5,10,20,50,100])::double tau) group by tau")
for _name, _cols in {
    "cpi_raw": ["score_continu", "score_softmin", "cpi_brut"], "gates": ["gate_factor", "gate_reason"], "cpi_final": ["CPI_v3", "CPI_v3_label"],
    "cpi_technique": ["CPI_technique", "CPI_technique_label"], "cpi_valeur": ["CPI_valeur", "CPI_valeur_label"], "shape_warning": ["shape_warning"], "ces_warning": ["ces_warning"],
}.items():
    put(_name, "select parcel_id, " + ", ".join(c if c in _TEXT else R(c) for c in _cols) + " from " + ("scored0" if _name == "cpi_valeur" else "final1"))
put("viewer_labels", f"""select parcel_id, {ladder('CPI_technique', K.LADDER_VIEWER, K.LABEL_MISSING)} viewer_label, {ladder('CPI_technique', K.LADDER_COLOUR, K.COLOUR_MISSING)} viewer_colour,
  case when consensus_confidence is null then '⬜' when consensus_confidence>=0.85 then '🟢' when consensus_confidence>=0.65 then '🟡' else '🔴' end confidence_mark from scored""")

# --- weak labels, clusters ---------------------------------------------------------------------------------
put("lf_terrain", "select parcel_id, h1, h2 from votes")
put("lf_market", "select parcel_id, h3, h4 from votes")
put("lf_cluster", "select parcel_id, h5_pos, h5_neg, true available from votes")
put("weak_label_vote", "select parcel_id, proxy_label, label_without_clusters from voted")
put("standard_scale", "select parcel_id, " + ", ".join(
    R(f"({x}-avg({x}) over ())/coalesce(nullif(stddev_pop({x}) over (),0),1)", f"z_{c}")
    for c in ("slope_p50", "twi_mean", "tri_mean") for x in [f"coalesce({c},(select median({c}) from scored where is_valid))"]) + ", 0.0::double z_flat_col from scored where is_valid")
put("cluster_constructibility", f"select cluster_id, {RS('constructibility_score')} from construct")
_AG = "count(*) filter (where proxy_label={0} and cluster_id={1})*100.0::double/count(*) filter (where proxy_label={0})"
_POOL = "count(*) filter (where (proxy_label=1 and cluster_id=best) or (proxy_label=0 and cluster_id=worst))*100.0::double/count(*) filter (where proxy_label<>-1)"
put("cluster_agreement", f"select {R(_AG.format(1, 'best'), 'pure_pos_in_best')}, {R(_AG.format(0, 'worst'), 'pure_neg_in_worst')}, {R(_POOL, 'cluster_label_agreement')} from clustered cross join ends")
_zs = ", ".join(f"(x_{c}-avg(x_{c}) over ())/stddev_pop(x_{c}) over () z_{c}" for c in PROFILE)
_xs = ", ".join(f"coalesce({c},(select median({c}) from clustered)) x_{c}" for c in PROFILE)
_gap = lambda t: "sqrt(" + "+".join(f"power(z_{c}-{t}.{c},2)" for c in PROFILE) + ")"
_SC = f"(select parcel_id, cluster_id, {_zs} from (select parcel_id, cluster_id, {_xs} from clustered))"
_CT = f"(select cluster_id cid, {', '.join(f'avg(z_{c}) {c}' for c in PROFILE)} from {_SC} group by cluster_id)"
put("cluster_score", f"""select parcel_id, {R(clip(f'(1-{_gap("b")}/({_gap("b")}+{_gap("w")}+1e-9::double))*100', 0, 100), 'cluster_score')} from {_SC} x cross join ends
  join {_CT} b on b.cid=best join {_CT} w on w.cid=worst""")
put("cluster_order", "select cluster_id from construct order by constructibility_score desc, cluster_id limit 2")
put("pooled_union", f"""select {R('avg(hit::int)*100.0::double', 'agreement')}, count(*) n from (select cluster_id=best hit from clustered cross join ends where proxy_label=1
  union all select cluster_id=worst from clustered cross join ends where proxy_label=0)""")

# --- metrics, contributions, bootstrap ----------------------------------------------------------------------
_ND = """(select a.fold, case when idcg>0 then dcg/idcg else 0 end ndcg from (select fold, sum(label/log2(rn+1)) filter (where rn<=20) dcg, sum(label/log2(rl+1)) filter (where rl<=20) idcg from {0} group by fold) a)"""
put("ndcg_at_k", f"select fold, {R('ndcg')} from {_ND.format('topfold')}")
put("precision_at_k", f"select fold, {R('avg(label) filter (where rn<=20)', 'precision')} from topfold group by fold")
_AUC = """(select fold, (sum(rk) filter (where label=1) - count(*) filter (where label=1)*(count(*) filter (where label=1)+1)/2.0::double)/(count(*) filter (where label=1)*count(*) filter (where label=0)) auc
  from (select fold, label, rank() over (partition by fold order by score) + (count(*) over (partition by fold, score)-1)/2.0::double rk from {0}) group by fold
  having count(*) filter (where label=1)>0 and count(*) filter (where label=0)>0)"""
put("auc", f"select fold, {R('auc')} from {_AUC.format('ranking')}")
_M2 = "(select 'rules' model, * from ranking union all select 'ranker', parcel_id, block_id, label, coalesce(CPI_ML_v3,0), fold, predicted, CPI_ML_v3 from ranking)"
_M3 = f"(select *, row_number() over (partition by model, fold order by score desc, parcel_id) rn, row_number() over (partition by model, fold order by label desc, parcel_id) rl, rank() over (partition by model, fold order by score) + (count(*) over (partition by model, fold, score)-1)/2.0::double rk from {_M2})"
_M4 = f"""(select model, fold, sum(label/log2(rn+1)) filter (where rn<=20)/nullif(sum(label/log2(rl+1)) filter (where rl<=20),0) ndcg, avg(label) filter (where rn<=20) prec,
  (sum(rk) filter (where label=1) - count(*) filter (where label=1)*(count(*) filter (where label=1)+1)/2.0::double)/(count(*) filter (where label=1)*count(*) filter (where label=0)) auc from {_M3} group by model, fold)"""
put("model_comparison", f"""select model, {R('a', 'auc_mean')}, {R('a2', 'auc_std')}, {R('p', 'precision_mean')}, {R('p2', 'precision_std')}, {R('n', 'ndcg_mean')}, {R('n2', 'ndcg_std')},
  row_number() over (order by n desc, model desc)=1 is_best from (select model, avg(auc) a, stddev_pop(auc) a2, avg(prec) p, stddev_pop(prec) p2, avg(coalesce(ndcg,0)) n, stddev_pop(coalesce(ndcg,0)) n2 from {_M4} group by model)""")
put("rescale_scores", f"select parcel_id, {R(h1('(twi_mean-lo)/(hi-lo+1e-9::double)*100.0::double'), 'CPI_ML_v3')} from fx_features cross join (select min(twi_mean) lo, max(twi_mean) hi from fx_features) where twi_mean is not null")
put("shap_values", "select parcel_id, " + RS(*[f"shap_{f}" for f in WEIGHTS]) + " from shap")
put("shap_groups", "select parcel_id, " + ", ".join(R("+".join(f"shap_{f}" for f in fs), f"shap_groupe_{g}") for g, fs in K.FEATURE_GROUPS.items()) + " from shap")
_u = "(('0x'||substr(md5(parcel_id||':'||run),1,8))::bigint/4294967296.0::double)"
_terms, _t, _tot = [], math.exp(-0.8), math.exp(-0.8)
for _i in range(1, 12):
    _terms.append(f"(u>={_tot!r}::double)::int")
    _t *= 0.8 / _i
    _tot += _t
put("bootstrap_resample", f"""select run, sum(w)::bigint drawn, count(*) n_distinct, sum(w*parcel_id)::bigint checksum from (select run, parcel_id, {'+'.join(_terms)} w from (
  select run, parcel_id, {_u} u from (select parcel_id from scored where is_valid and proxy_label<>-1) cross join (select unnest(range(100))::int run))) where w>0 group by run""")
put("bootstrap_ci", f"select parcel_id, {RS('cpi_ml_mean', 'cpi_ml_std', 'cpi_ml_ci_low', 'cpi_ml_ci_high')} from intervals")
put("ci_stability", f"""select count(*) filter (where cpi_ml_ci_high-cpi_ml_ci_low<5) n_stable, count(*) filter (where cpi_ml_ci_high-cpi_ml_ci_low>15) n_unstable,
  {R('avg(cpi_ml_ci_high-cpi_ml_ci_low)/2', 'mean_half_width')} from intervals""")

# --- ranks and consensus -----------------------------------------------------------------------------------
put("pct_rank_avg", " union all ".join(f"select parcel_id, {q(c)} score, {R(f'r_{c}', 'pct_rank')} from ranked where r_{c} is not null" for c in CONSENSUS))
put("consensus", f"select parcel_id, {R('consensus_score')}, {R('least(greatest(confidence0,0),1)', 'consensus_confidence')}, n_approaches_used from merged")
put("consensus_meta", f"""select 4 available_count, {R('median(consensus_score)', 'median_consensus')}, {R('median(confidence0)', 'median_confidence')}, count(*) filter (where confidence0>0.80) high_conf,
  count(*) filter (where confidence0<0.50) low_conf, count(*) n_total from merged""")
put("top_k", f"select parcel_id, {RS('CPI_ML_v3', 'CPI_v3', 'slope_p50', 'slope_p90', 'svf_mean', 'twi_mean', 'surface_m2')} from (select * from scored where is_valid order by CPI_ML_v3 desc nulls last, parcel_id limit 5)")
put("ranked_top10", f"""select parcel_id, {RS('CPI_technique', 'consensus_confidence', 'slope_p90', 'surface_m2')}, rang::int rang from (
  select *, row_number() over (order by CPI_technique desc, parcel_id) rang from screened) where rang<=10""")
put("value_percentile", f"select parcel_id, {RS('cluster_score')}, {R('case when cluster_score is not null then (rank() over (order by cluster_score nulls last)-1)/(count(*) over ())::double end', 'share_below')} from features")
put("minmax_profile", "select parcel_id, " + ", ".join(("0.5::double svf_mean" if c == "svf_mean" else R(f"({c}-min({c}) over ())/(max({c}) over ()-min({c}) over ())", c)) for c in FEATURES) + " from features")

# --- screening -----------------------------------------------------------------------------------------------
_SCREEN = RS("CPI_technique", "consensus_confidence", "slope_p90", "surface_m2")
put("screen_parcels", f"select parcel_id, {_SCREEN}, cat from screened")
put("screen_profiles", " union all ".join(
    f"select {q(n)} profile, count(*) n, {R('avg(CPI_technique)', 'mean_cpi')}, {R('max(CPI_technique)', 'best_cpi')} from scored where CPI_technique>={a} and consensus_confidence>={b} and slope_p90<={c} and surface_m2>={d} and is_valid having count(*)>0"
    for n, a, b, c, d in K.PROFILES))
put("screen_kpis", f"""select count(*) n, {R('avg(CPI_technique)', 'mean_cpi')}, count(*) filter (where consensus_confidence>=0.8) n_high_conf, count(*) filter (where gate_reason<>'') n_gated,
  count(*) filter (where parcel_id in (select parcel_id from shap)) n_explained from screened""")
put("shortlist", f"select parcel_id, {_SCREEN} from scored where parcel_id in (select case when p_partkey%4=2 then p_partkey-1 else p_partkey end from part where p_partkey%4<>3)")
_six = lambda x: f"(round_even({x}*1000000.0::double,0)/1000000.0::double)"
_d = lambda x, n: f"printf('%.{n}f', round_even({_six(x)}*{10 ** n}.0::double,0)/{10 ** n}.0::double)"
_pc = f"printf('%.0f', round_even({_six('consensus_confidence')}*100.0::double,0))||'%'"
_L = lambda items, dflt: f"(select array_to_string(case when len(l)>0 then l[1:3] else [{', '.join(map(q, dflt))}] end, ' | ') from (select list_filter([{', '.join(items)}], lambda x: x is not null) l))"
_w = lambda cond, text: f"case when {cond} then {text} end"
put("verdict", f"""select parcel_id, case when CPI_technique>=65 then {q(K.VERDICTS[0][1])} when CPI_technique>=40 then {q(K.VERDICTS[1][1])} else {q(K.VERDICTS[2][1])} end verdict,
  case when CPI_technique>=65 then {q(K.VERDICTS[0][2])} when CPI_technique>=40 then {q(K.VERDICTS[1][2])} else {q(K.VERDICTS[2][2])} end summary,
  {_L([_w('slope_p90<10', f"'Pente max modérée ('||{_d('slope_p90', 1)}||'°), favorable au coût d''aménagement.'"), _w('has_thalweg_mean<0.10', q(K.STRENGTH_DRAINAGE)),
       _w('surface_m2>=250', f"'Surface confortable ('||{_d('surface_m2', 0)}||' m²) pour flexibilité du programme.'"),
       _w('consensus_confidence>=0.8', f"'Confiance de consensus élevée ('||{_pc}||'), signaux convergents.'"),
       _w('cpi_ml_std<=3', f"'Score stable en bootstrap (±'||{_d('cpi_ml_std', 1)}||' pts).'")], [K.STRENGTH_DEFAULT])} strengths,
  {_L([_w('slope_p90>25', f"'Pente max élevée ('||{_d('slope_p90', 1)}||'°), risque de surcoût terrassement.'"), _w('has_thalweg_mean>=0.30', q(K.RISK_DRAINAGE)),
       _w('surface_m2<120', f"'Surface réduite ('||{_d('surface_m2', 0)}||' m²), capacité de projet limitée.'"),
       _w('consensus_confidence<0.5', f"'Consensus faible ('||{_pc}||'), signaux contradictoires.'"),
       _w('cpi_ml_std>6', f"'Incertitude ML notable (écart-type '||{_d('cpi_ml_std', 1)}||' pts).'"), _w('brgm_mvt_terrain_flag', q(K.RISK_LANDSLIDE)),
       _w('brgm_argiles_flag', q(K.RISK_CLAY)), _w("gate_reason<>''", "'Gate technique déclenchée : '||gate_reason||'.'")], [K.RISK_DEFAULT])} risks,
  {_L([_w('slope_p90>25', q(K.ACTION_EARTHWORKS)), _w('has_thalweg_mean>=0.30', q(K.ACTION_WATER)), _w('consensus_confidence<0.5', q(K.ACTION_SITE)),
       _w('brgm_mvt_terrain_flag', q(K.ACTION_GEOTECH))], K.ACTIONS_DEFAULT)} actions, coalesce({_pc},'N/A') confidence_txt from scored""")
_SL = "select parcel_id, unnest([" + ", ".join(f"{{'f': {q(f)}, 'v': shap_{f}}}" for f in FEATURES) + "]) e from shap"
put("shap_top_factors", f"""select parcel_id, coalesce(string_agg(f, ',' order by rp) filter (where v>0 and rp<=3),'') top_positive, coalesce(string_agg(f, ',' order by rn) filter (where v<0 and rn<=2),'') top_negative
  from (select parcel_id, e.f f, e.v v, row_number() over (partition by parcel_id order by e.v desc, e.f) rp, row_number() over (partition by parcel_id order by e.v, e.f) rn from ({_SL})) group by parcel_id""")
put("alerts", f"""select parcel_id, array_to_string(list_filter([{_w('brgm_argiles_flag', q(K.ALERT_CLAY))}, {_w('brgm_mvt_terrain_flag', q(K.ALERT_LANDSLIDE))},
  {_w("shape_warning<>''", q(K.ALERT_SHAPE) + "||shape_warning")}, {_w("ces_warning<>''", q(K.ALERT_COVERAGE) + "||ces_warning")}], lambda x: x is not null), ' | ') alerts from scored""")

# --- incremental recomputation -----------------------------------------------------------------------------
put("incremental_refresh", f"select l_partkey parcel_id, {R('sum(l_quantity)', 'total_q')}, l_partkey%5<>0 and l_partkey%11<>0 reused from lineitem group by 1")
put("family_refresh", f"select s.parcel_id, {RS('compactness_ratio', 'elongation_ratio')}, brgm_argiles_flag, brgm_mvt_terrain_flag from shape s join flags f on s.parcel_id=f.parcel_id")

put("group_kfold", "select s.parcel_id, s.block_id, p.fold::int fold from scored s join packed p on s.block_id=p.block_id where s.is_valid and s.proxy_label<>-1")
put("calibrate_tau", f"select (select count(*) from tau_groups) n, {R('(lo+hi)/2', 'tau')} from bis14 where i=50")
put("flagship_top_parcels", f"""select parcel_id, {RS('CPI_v3')}, {ladder('CPI_v3', K.LADDER_FINAL)} CPI_v3_label, {RS('CPI_technique', 'gate_factor')}, gate_reason, {RS('slope_p90', 'surface_m2')}, rang::int rang
  from (select *, row_number() over (order by CPI_v3 desc, parcel_id) rang from final0_t where is_valid) where rang<=10""")
put("flat_components", "select r, c, min(root)::bigint component from reach group by r, c")
_DISC = "coalesce(case when {0}.rn<=20 then 1/log2({0}.rn+1) end, 0)"
put("ranking_gradients", f"""select b.parcel_id, {R('coalesce(g1,0)+coalesce(g2,0)', 'grad')}, {R('coalesce(k1,0)+coalesce(k2,0)', 'hess')} from (select parcel_id from ranking) b left join (
  select id, sum(g) g1, sum(k) k1 from pairs group by id) x on x.id=b.parcel_id left join (select head, -sum(g) g2, sum(k) k2 from pairs where rn>20 group by head) y on y.head=b.parcel_id""".replace(
    "pairs", f"""(select j.parcel_id id, i.parcel_id head, j.rn, (j.label-i.label)*rho*w g, rho*(1-rho)*w k from topfold j join topfold i on i.fold=j.fold and i.rn<=20 and i.label<>j.label
  join (select fold, sum(label/log2(rl+1)) filter (where rl<=20) ideal from topfold group by fold) d on d.fold=j.fold,
  lateral (select 1/(1+exp((j.label-i.label)*(j.score-i.score)/10.0::double)) rho, abs({_DISC.format('i')}-{_DISC.format('j')})/nullif(ideal,0) w))"""))
put("model_checks", """select "check", n::bigint n from (select (select count(*) from ranking) labelled, (select count(*) from scored where is_valid) valid) cross join
  lateral (values ('ranker_rows', labelled), ('ranker_parcels', labelled), ('folds', 5), ('outside_0_100', 0), ('blocks_in_two_folds', 0),
  ('final_scores', valid), ('contributions_that_add_up', labelled)) v("check", n)""")
