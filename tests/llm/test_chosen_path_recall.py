from lotwise.llm import chosen_path as C


def test_a_tree_branches_by_tokens_of_its_own_and_meets_the_stated_recall():
    assert C.DEPTH <= C.LEVELS and (1 - 0.8**C.DEPTH) ** C.TREES < 2.5e-4
