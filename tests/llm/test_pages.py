import numpy as np
import pyarrow as pa

from nestwork.llm.pages import fold, grams, letters, ordered_lines, read_pages


def page(*lines):
    """(x, y, text) lines"""
    return "\n".join(t for _, _, t in lines), np.array([x for x, _, _ in lines]), np.array([y for _, y, _ in lines])


def test_columns_read_row_by_row():
    assert ordered_lines(*page((80, 10, "a1"), (480, 10, "b1"), (83, 30, "a2"), (478, 30, "b2"))) == ["a1", "a2", "b1", "b2"]


def test_columns_in_the_wrong_order_and_unsorted_lines():
    assert ordered_lines(*page((480, 10, "b1"), (480, 30, "b2"), (80, 30, "a2"), (80, 10, "a1"))) == ["a1", "a2", "b1", "b2"]


def test_joined_lines_are_cut():
    p = page((80, 10, "first left   first right"), (80, 30, "left two"), (480, 30, "right two"))
    assert ordered_lines(*p) == ["first left", "left two", "first right", "right two"]
    three = page((80, 10, "a1   b1   c1"), (80, 30, "a2"), (480, 30, "b2"), (880, 30, "c2"))
    assert ordered_lines(*three) == ["a1", "a2", "b1", "b2", "c1", "c2"]


def test_adverts_come_last():
    assert ordered_lines(*page((80, 10, "a1"), (104, 30, "ADVERT"), (80, 50, "a2"), (83, 70, "a3"))) == ["a1", "a2", "a3", "ADVERT"]


def test_without_boxes_lines_stay():
    assert ordered_lines("b\na", None, None) == ["b", "a"]
    assert ordered_lines("a  b\nc", np.array([1]), np.array([1])) == ["a", "b", "c"]


def test_read_pages_of_a_batch():
    xs = pa.array([[480, 80], None, [1, None], [], [1]], pa.list_(pa.int32()))
    ys = pa.array([[1, 1], [1, 2], [1, 2], [], None], pa.list_(pa.int32()))
    texts = pa.array(["b\na", "x\ny", "x\ny", None, ""])
    batch = pa.RecordBatch.from_arrays([texts, xs, ys], ["text", "xs", "ys"])
    want = [["a", "b"], ["x", "y"], ["x", "y"], [], []]
    assert list(read_pages(batch)) == want
    assert list(read_pages(batch.slice(1, 2))) == want[1:3]


def test_fold():
    assert fold("Ärger, ein\nKÄSE-brot") == "arger ein\nkasebrot"
    assert letters("a-b c\n1ß") == "abc1ß"


def test_grams():
    g = grams("abcabcä", 3)
    assert len(g) == 5 and g[0] == g[3] and len(set(g.tolist())) == 4
    assert len(grams("ab", 3)) == 0
