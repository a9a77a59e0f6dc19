"""Entities and relation trees for tests: lists with owners, tags (composite key) and clips, and self-made data."""

from nestwork.plans.relations import Relation, validate

KEYS = {"owner": ["owner_id"], "tag": ["id"], "list": ["id"], "list_tag": ["list_id", "tag_id"], "entry": ["id"], "clip": ["id"]}
SCHEMAS = {
    "owner": "owner_id long, name string",
    "tag": "id int, owner_id long, label string",
    "list": "id long, owner_id int, title string",
    "list_tag": "list_id long, tag_id long, kind string",
    "entry": "id long, list_id long, clip_id long, pos int",
    "clip": "id long, status string, owner_id long",
}
FIELDS = {e: [f.split()[0] for f in s.split(", ")] for e, s in SCHEMAS.items()}


def child(entity, join_key, parent_key, *children):
    return Relation(entity, None, join_key, parent_key, children)


LISTS = Relation(
    "list", "DenormalizedList", None, None,
    (
        child("owner", "owner_id", "owner_id"),
        child("list_tag", "list_id", "id", child("tag", "id", "tag_id")),
        child("entry", "list_id", "id", child("clip", "id", "clip_id", child("owner", "owner_id", "owner_id"))),
    ),
)
CLIPS = Relation("clip", "DenormalizedClip", None, None, (child("owner", "owner_id", "owner_id"), child("entry", "clip_id", "id", child("list", "id", "list_id"))))
TREES = validate([LISTS, CLIPS])


def record(entity, rng):
    small = lambda *extra: rng.choice([1, 2, 3, 255, 256, 300, *extra])
    text = lambda: rng.choice(["a", "b", "ü", None])
    return {
        "owner": lambda: {"owner_id": small(), "name": text()},
        "tag": lambda: {"id": small(), "owner_id": small(None), "label": text()},
        "list": lambda: {"id": small(), "owner_id": small(None, 999), "title": text()},
        "list_tag": lambda: {"list_id": small(None), "tag_id": small(None, 999), "kind": text()},
        "entry": lambda: {"id": rng.randrange(1, 40), "list_id": small(None), "clip_id": small(None, 999), "pos": rng.randrange(5)},
        "clip": lambda: {"id": small(), "status": rng.choice(["ready", "deleted", None]), "owner_id": small(None)},
    }[entity]()
