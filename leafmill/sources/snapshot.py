"""Persistence: Parquet for tables of trees, and a strict binary form of single trees.

The binary form: magic `LFMSNAP1`, then little-endian unsigned 32-bit numbers and length-prefixed UTF-8 strings: language id,
language version, place of the root record, the table of texts, the records. Records are in post-order and each different subtree
is written once: (1, kind, length, text storage, text place) for a token, (2, kind, length, n, n places of earlier records) for a node.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .forest import ELEMENTS, NULLABLE, Plan, Rows, by_tree, different_tokens, frame, plain, taken
from .languages import Language, kind_number

MAGIC = b"LFMSNAP1"
STORAGES = ("static", "interned", "large", "missing")
#: What a quarantined snapshot is called by.
ERRORS = ("bad_magic", "language_mismatch", "truncated_input", "trailing_bytes", "invalid_utf8", "invalid_root", "root_is_token", "invalid_reference", "invalid_text_reference", "invalid_record_tag", "unknown_kind", "length_mismatch", "static_text_unavailable", "static_kind_requires_static_text")


NO_TEXT = bytes(4)


class SnapshotError(ValueError):
    @property
    def code(self) -> str:
        return self.args[0]


def save(elements: DataFrame, path: str) -> None:
    """Sorted by tree and place within files, so that readers skip by statistics."""
    elements.repartition("tree_id").sortWithinPartitions("tree_id", "pre").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def encode_rows(rows: list, language: Language) -> bytes:
    """rows: (pre, parent_pre, is_node, kind, length, storage, text) of one tree in preorder."""
    pre, parent, is_node, kind, length, storage, text = zip(*rows)
    columns = {c: np.array(x) for c, x in (("pre", pre), ("is_node", is_node), ("kind", kind), ("end", length))}
    columns |= {"parent_pre": np.array([-1 if x is None else x for x in parent]), "start": np.zeros(len(rows), np.int64), "slot": np.arange(len(rows)), "storage": pa.array(storage, pa.string()), "text": pa.array(text, pa.string())}
    return encode_trees(Rows(pa.array([0]), np.zeros(len(rows), np.int64), columns), language)[0]


def encode_trees(e: Rows, language: Language) -> list[bytes]:
    """The snapshot of each tree. Tokens are told apart once for all trees, so that a token costs a look-up."""
    def string(text: str) -> bytes:
        data = text.encode()
        return struct.pack("<I", len(data)) + data

    name = string(language.id)
    is_node, kind, length = e["is_node"], e["kind"].astype(np.int64), (e["end"] - e["start"]).astype(np.int64)
    token, seen, number = different_tokens(e)
    stored, said = (taken(e[c], seen).fill_null("").to_pylist() for c in ("storage", "text"))
    # What a token's record begins with, and its text where that is in the table of texts.
    shapes = [(struct.pack("<BIIB", 1, k, n, STORAGES.index(s)), string(t) if s in ("interned", "large") else None) for k, n, s, t in zip(kind[seen].tolist(), length[seen].tolist(), stored, said)]
    of = np.full(len(e), -1)
    of[token] = number
    of = of.tolist()
    own, first = e.brothers()
    heads = np.flatnonzero(first == np.arange(len(first)))
    tails = np.append(heads[1:], len(own))[: len(heads)].tolist()
    span = dict(zip(e.up()[own[heads]].tolist(), zip(heads.tolist(), tails)))
    own, kind, length = own.tolist(), kind.tolist(), length.tolist()
    bounds = np.searchsorted(e.tree, np.arange(len(e.ids) + 1))
    node = np.flatnonzero(is_node)
    out, at = [0] * len(e), []  # the place of each element's record; the snapshots
    for begin, end in zip(bounds.tolist(), bounds[1:].tolist()):
        texts: dict[bytes, bytes] = {}  # with their places
        known: dict = {}  # places of records, by number for tokens and by bytes for nodes
        records: list[bytes] = []
        behind = end
        for n in [*node[slice(*np.searchsorted(node, [begin, end]))][::-1].tolist(), begin - 1]:
            for x in dict.fromkeys(of[n + 1 : behind][::-1]):
                if x not in known:
                    head, text = shapes[x]
                    known[x] = len(records)
                    records.append(head + (NO_TEXT if text is None else texts.setdefault(text, len(texts).to_bytes(4, "little"))))
            out[n + 1 : behind] = map(known.__getitem__, of[n + 1 : behind])
            if n >= begin:
                kids = [out[i] for i in own[slice(*span.get(n, (0, 0)))]]
                record = struct.pack(f"<BIII{len(kids)}I", 2, kind[n], length[n], len(kids), *kids)
                place = known.get(record)
                if place is None:
                    place = known[record] = len(records)
                    records.append(record)
                out[n] = place
            behind = n
        at.append(b"".join([MAGIC, name, struct.pack("<II", language.version, out[begin] if end > begin else 0), struct.pack("<I", len(texts)), *texts, struct.pack("<I", len(records)), *records]))
    return at


def decode_bytes(data: bytes, language: Language) -> list[tuple]:
    """The rows of ELEMENTS, without tree_id, or SnapshotError. Counts are checked against the bytes that are left before anything is made."""
    e = decode_trees(pa.array([0]), [data], language)
    if e["error"][0].is_valid:
        raise SnapshotError(e["error"][0].as_py())
    none = lambda c: [None if x < 0 else x for x in e[c].tolist()]
    lists = [none(c) if t in NULLABLE else e[c].tolist() if isinstance(e[c], np.ndarray) else e[c].to_pylist() for c, t in DECODED.items() if c != "error"]
    return list(zip(*lists))


def records_of(data: bytes, language: Language, known: dict) -> tuple[int, list, list, list, list, list]:
    """The root's place, and of each record: kind, length, storage, text, and a node's children (None for a token)."""
    size, at = len(data), 0

    def number() -> int:
        nonlocal at
        if size - at < 4:
            raise SnapshotError("truncated_input")
        at += 4
        return struct.unpack_from("<I", data, at - 4)[0]

    def string() -> str:
        nonlocal at
        n = number()
        if n > size - at:
            raise SnapshotError("truncated_input")
        at += n
        try:
            return data[at - n : at].decode()
        except UnicodeDecodeError as e:
            raise SnapshotError("invalid_utf8") from e

    if size < 8:
        raise SnapshotError("truncated_input")
    at = 8
    if data[:8] != MAGIC:
        raise SnapshotError("bad_magic")
    found, version, root = string(), number(), number()
    if (found, version) != (language.id, language.version):
        raise SnapshotError("language_mismatch")
    texts, sizes, length_of = [], [], struct.Struct("<I").unpack_from
    for _ in range(_count(number(), 4, size - at)):
        if size - at < 4:
            raise SnapshotError("truncated_input")
        (n,) = length_of(data, at)
        at += 4 + n
        if at > size:
            raise SnapshotError("truncated_input")
        try:
            texts.append(data[at - n : at].decode())
        except UnicodeDecodeError as e:
            raise SnapshotError("invalid_utf8") from e
        sizes.append(n)
    kinds, lengths, storages, said, below = [], [], [], [], []
    head, tail = struct.Struct("<BII").unpack_from, struct.Struct("<BI").unpack_from
    for _ in range(_count(number(), 13, size - at)):
        if size - at < 9:
            raise SnapshotError("truncated_input")
        tag, kind, length = head(data, at)
        at += 9
        if tag not in (1, 2):
            raise SnapshotError("invalid_record_tag")
        if kind not in known:
            raise SnapshotError("unknown_kind")
        if tag == 2:
            n = _count(number(), 4, size - at)
            kids = struct.unpack_from(f"<{n}I", data, at)
            at += 4 * n
            if kids and max(kids) >= len(kinds):
                raise SnapshotError("invalid_reference")
            if sum(map(lengths.__getitem__, kids)) != length:
                raise SnapshotError("length_mismatch")
            storage, text = "node", None
        else:
            if size - at < 5:
                raise SnapshotError("truncated_input")
            (code, place), kids = tail(data, at), None
            at += 5
            if code >= len(STORAGES):
                raise SnapshotError("invalid_record_tag")
            storage, fixed = STORAGES[code], known[kind]
            if storage == "static":
                if fixed is None:
                    raise SnapshotError("static_text_unavailable")
                text, n = fixed, len(fixed.encode())
            elif storage == "missing":
                text, n = "", 0
            else:
                if fixed is not None:
                    raise SnapshotError("static_kind_requires_static_text")
                if place >= len(texts):
                    raise SnapshotError("invalid_text_reference")
                text, n = texts[place], sizes[place]
            if n != length:
                raise SnapshotError("length_mismatch")
        kinds.append(kind)
        lengths.append(length)
        storages.append(storage)
        said.append(text)
        below.append(kids)
    if at != size:
        raise SnapshotError("trailing_bytes")
    if root >= len(kinds):
        raise SnapshotError("invalid_root")
    if below[root] is None:
        raise SnapshotError("root_is_token")
    return root, kinds, lengths, storages, said, below


def spread_out(root: int, lengths: list, below: list) -> dict[str, np.ndarray]:
    """The elements of a tree of records in preorder, `record` among their columns; each node places its children at once."""
    sizes, nodes = [], np.array([x is not None for x in below])
    for kids in below:
        sizes.append(1 if kids is None else 1 + sum(map(sizes.__getitem__, kids)))
    total, size, length = sizes[root], np.array(sizes), np.array(lengths, np.int64)
    out = {c: np.full(total, -1, np.int64) for c in ("parent_pre", "node_slot")} | {c: np.zeros(total, np.int64) for c in ("slot", "depth", "start", "node_child_count", "record")}
    out["record"][0] = root
    made: dict[int, tuple] = {}  # of each record of a node: its children's records, node children, places and starts
    todo = [0]
    while todo:
        pre = todo.pop()
        record = out["record"][pre]
        if record not in made:
            kids = np.array(below[record], np.int64)
            here = np.flatnonzero(nodes[kids])
            made[record] = kids, here, 1 + np.cumsum(size[kids]) - size[kids], np.cumsum(length[kids]) - length[kids]
        kids, here, places, starts = made[record]
        at = pre + places
        out["record"][at], out["parent_pre"][at], out["slot"][at], out["depth"][at] = kids, pre, np.arange(len(kids)), out["depth"][pre] + 1
        out["start"][at] = out["start"][pre] + starts
        out["node_slot"][at[here]] = np.arange(len(here))
        out["node_child_count"][pre] = len(here)
        todo += at[here].tolist()
    record = out["record"]
    counts = np.array([0 if x is None else len(x) for x in below])
    return out | {"pre": np.arange(total), "last": np.arange(total) + size[record] - 1, "is_node": nodes[record], "end": out["start"] + length[record], "child_count": counts[record]}


def decode_trees(ids: pa.Array, snapshots: list[bytes], language: Language) -> Rows:
    """DECODED of the snapshots; one that is not valid gives one row of nulls and the error."""
    known = {kind_number(k.number): k.static_text for k in language.kinds}
    trees, errors, parts = [], [], []
    kinds, storages, texts = [-1], [None], [None]  # of all records; the first is that of an error
    for tree, data in enumerate(snapshots):
        try:
            root, kind, length, storage, text, below = records_of(data, language, known)
            part = spread_out(root, length, below)
            part["record"] = part["record"] + len(kinds)
            kinds += kind
            storages += storage
            texts += text
            errors.append(None)
        except SnapshotError as e:
            part = {c: np.full(1, 0 if c == "record" else -1) for c in NUMBERS}
            errors.append(e.code)
        trees.append(np.full(len(part["record"]), tree))
        parts.append(part)
    columns = {c: np.concatenate([p[c] for p in parts]) for c in NUMBERS} if parts else {c: np.zeros(0, np.int64) for c in NUMBERS}
    record, tree = columns.pop("record"), np.concatenate(trees) if trees else np.zeros(0, np.int64)
    flag = columns["is_node"]
    columns["is_node"] = pa.array(flag > 0, mask=record == 0)
    text = lambda values: pa.array(values, pa.string()).take(pa.array(record))
    return Rows(ids, tree, columns | {"kind": np.array(kinds, np.int64)[record], "storage": lambda: text(storages), "text": lambda: text(texts), "error": pa.array(errors, pa.string()).take(pa.array(tree))})


def _count(n: int, size: int, left: int) -> int:
    if n * size > left:
        raise SnapshotError("truncated_input")
    return n


#: Columns of decoded snapshots: those of elements, all of which may be null, and `error`.
DECODED = {c: {"int": "place", "bigint": "number"}.get(t, t) for c, t in ELEMENTS.items()} | {"error": "string"}
NUMBERS = [c for c, t in DECODED.items() if t != "string" and c != "kind"] + ["record"]


def encode(elements: DataFrame, language: Language) -> DataFrame:
    """tree_id, snapshot BINARY."""
    def run(e: Rows) -> Rows:
        trees, all_of = np.unique(e.tree), encode_trees(e, language)
        return Rows(e.ids, trees, {"snapshot": pa.array([all_of[t] for t in trees], pa.binary())})

    return by_tree(elements, run, {"snapshot": "binary"})


def decode(snapshots: DataFrame, language: Language) -> DataFrame:
    """ELEMENTS of the snapshots, and `error`: a snapshot that is not valid gives one row with the error alone."""
    def make(batch: pa.RecordBatch) -> Rows:
        return decode_trees(batch.column("tree_id"), batch.column("snapshot").to_pylist(), language)

    return frame(Plan(snapshots.select("tree_id", "snapshot"), make, DECODED))


def valid(decoded: DataFrame) -> DataFrame:
    """ELEMENTS of the snapshots that have no error."""
    return by_tree(decoded, lambda e: e.take(e["pre"] >= 0, is_node=plain(e["is_node"])[e["pre"] >= 0]), ELEMENTS)
