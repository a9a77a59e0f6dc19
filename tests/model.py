"""Nested documents in plain Python: what the builder and the engine must come to."""

import json


def key_bytes(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return b"\1" if v else b"\0"
    if isinstance(v, int):
        return v.to_bytes(8, "big", signed=True) if v < 0 else v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big")
    if isinstance(v, str):
        return v.encode()
    raise TypeError(v)


def pk_bytes(record, keys):
    parts = [key_bytes(record[k]) or b"" for k in sorted(keys)]
    return parts[0] if len(parts) == 1 else b"".join(bytes([len(p)]) + p for p in parts)


def document(records, relation, pk):
    """``records``: entity -> {pk bytes: record}. None where the root has no record."""
    record = records[relation.entity].get(pk)
    if record is None:
        return None
    children = {}
    for child in relation.children:
        wanted = key_bytes(record[child.parent_key])
        if wanted is not None:
            found = [p for p, r in records[child.entity].items() if key_bytes(r[child.join_key]) == wanted]
            children[child.entity] = [document(records, child, p) for p in sorted(found)]
    return {"Record": {k: v for k, v in record.items() if v is not None}, "Children": children}


def documents(records, root):
    return {pk: document(records, root, pk) for pk in records[root.entity]}


def looked_up(records, root):
    """The parent index: (edge, key bytes, root pk)."""
    out = set()

    def below(node, path, pk, record):
        for child in node.children:
            wanted = key_bytes(record[child.parent_key])
            if wanted:
                out.add(("/".join((*path, child.entity)), wanted, pk))
                for r in records[child.entity].values():
                    if key_bytes(r[child.join_key]) == wanted:
                        below(child, (*path, child.entity), pk, r)

    for pk, record in records[root.entity].items():
        below(root, (root.entity,), pk, record)
    return out


def parsed(text):
    return None if text is None else json.loads(text)
