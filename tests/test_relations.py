import json

import pytest

from nestwork.plans.relations import Relation, RelationError, edges, entities, find, load, validate

TREE = {
    "DenormalizedName": "Doc",
    "Entity": "list",
    "Children": [
        {"Entity": "owner", "JoinKey": "owner_id", "ParentKey": "owner_id"},
        {"Entity": "entry", "JoinKey": "list_id", "ParentKey": "id", "Children": [{"Entity": "clip", "JoinKey": "id", "ParentKey": "clip_id"}]},
    ],
}


def test_round_trip_and_edges():
    root = validate([Relation.from_json(TREE)])[0]
    assert root.to_json() == TREE
    assert [e.id for e in edges(root)] == ["list/owner", "list/entry", "list/entry/clip"]
    assert [e.join_index for e in edges(root)] == ["JK|owner|owner_id", "JK|entry|list_id", "JK|clip|id"]
    assert [e.parent_index for e in edges(root)] == ["PaK|list|list|owner_id", "PaK|list|list|id", "PaK|list|entry|clip_id"]


def test_entities_children_first():
    other = Relation.from_json({"DenormalizedName": "C", "Entity": "clip", "Children": [{"Entity": "owner", "JoinKey": "a", "ParentKey": "b"}]})
    assert entities([Relation.from_json(TREE), other]) == ["entry", "owner", "clip", "list"]


def test_find():
    root = Relation.from_json(TREE)
    assert find(root, "list") == [(None, root)]
    assert [(p.entity, c.join_key) for p, c in find(root, "clip")] == [("entry", "id")]
    assert find(root, "nothing") == []


@pytest.mark.parametrize(
    "change",
    [
        lambda t: t.pop("DenormalizedName"),
        lambda t: t.pop("Entity"),
        lambda t: t.pop("Children"),
        lambda t: t["Children"][0].pop("JoinKey"),
        lambda t: t["Children"][1]["Children"][0].pop("ParentKey"),
        lambda t: t["Children"].append(t["Children"][0]),
        lambda t: t.update(Unknown=1),
    ],
)
def test_broken_trees(change):
    tree = json.loads(json.dumps(TREE))
    change(tree)
    with pytest.raises(RelationError):
        validate([Relation.from_json(tree)])


def test_names_are_unique():
    with pytest.raises(RelationError):
        validate([Relation.from_json(TREE)] * 2)


def test_load(tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.json").write_text(json.dumps([TREE | {"DenormalizedName": f"D{i}"}]))
    assert [r.denormalized_name for r in load([str(tmp_path / "1.json"), f"file://{tmp_path}/2.json"])] == ["D1", "D2"]
    with pytest.raises(RelationError):
        load(["http://x/y.json"])
