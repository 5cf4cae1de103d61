"""Trees of plain text: root, lines, and tokens; or root, turns, lines and tokens.

Texts are cut by the classes of their bytes, many texts at once in numpy, where their rows stand (see forest.py): a document needs no
shuffle, and of a conversation only its turns are brought together. A last line without a newline ends with a missing newline token of no length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import forest
from .languages import TEXT

LINE = r"[^\n]*\n|[^\n]+"
TOKEN = r"\n|[ \t\r]+|[0-9]+|[^ \t\r\n0-9]+"
ELEMENTS = ("tree_id", *forest.ELEMENTS)
STORAGES = ("node", "static", "interned", "missing")
#: The class of each byte: those of letters beyond ASCII are words, as a whole letter is.
WORD, NUMBER, SPACE, NEWLINE = range(4)
CLASS = np.zeros(256, np.uint8)
CLASS[list(b"0123456789")], CLASS[list(b" \t\r")], CLASS[10] = NUMBER, SPACE, NEWLINE
KINDS = np.array([TEXT["word"], TEXT["number"], TEXT["space"], TEXT["newline"]], np.int64)


def tokens(text: Column) -> Column:
    """array<string>: the tokens of a text; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_kind(token: Column) -> Column:
    return (
        F.when(token == "\n", TEXT["newline"]).when(token.rlike(r"^[ \t\r]"), TEXT["space"]).when(token.rlike("^[0-9]"), TEXT["number"]).otherwise(TEXT["word"])
    )


def document_elements(docs: DataFrame, tree_id: str = "doc_id", text: str = "text") -> DataFrame:
    """ELEMENTS of each document: root (depth 0), lines (1), tokens (2). Null texts count as empty: a root alone."""
    rows = docs.select(F.col(tree_id).alias("tree_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(cores, "tree_id") if len(docs.inputFiles()) < cores else rows

    def make(batch: pa.RecordBatch) -> forest.Rows:
        return elements_of(batch.column("tree_id"), batch.column("text"), np.arange(batch.num_rows), False)

    return forest.frame(forest.Plan(rows, make, dict(forest.ELEMENTS)))


def conversation_elements(turns: DataFrame, tree_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """ELEMENTS of each conversation: root, turns (1), lines (2), tokens (3); turns in the order of their numbers."""
    own = turns.select(F.col(tree_id).alias("tree_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    rows = own.groupBy("tree_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("tree_id", F.transform("t", lambda x: x["text"]).alias("turns"))

    def make(batch: pa.RecordBatch) -> forest.Rows:
        turns = batch.column("turns")
        lengths = turns.value_lengths().fill_null(0).to_numpy()
        return elements_of(batch.column("tree_id"), turns.flatten(), np.repeat(np.arange(batch.num_rows), lengths), True)

    return forest.frame(forest.Plan(rows, make, dict(forest.ELEMENTS)))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where in them each begins; the last place is the end."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(places, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def texts_at(data: np.ndarray, places: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Strings that follow each other in the bytes; `places` has where each begins, and the end."""
    known = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(places) - 1, [known, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)])


def elements_of(ids: pa.Array, texts: pa.Array, tree_of: np.ndarray, turns: bool) -> forest.Rows:
    """texts: the sections of the trees, tree after tree; tree_of: the tree of each. Every section is a turn, or the one of its tree."""
    trees, sections, level = len(ids), len(texts), 2 if turns else 1
    data, off = bytes_of(texts)
    size = len(data)
    full = off[1:] > off[:-1]
    kind_of_byte = CLASS[data]
    begins = np.ones(size, bool)
    begins[1:] = (kind_of_byte[1:] != kind_of_byte[:-1]) | (kind_of_byte[1:] == NEWLINE)
    begins[off[:-1][full]] = True
    tok = np.flatnonzero(begins)
    n, cls = len(tok), kind_of_byte[tok]
    sec_tok = np.searchsorted(tok, off[:-1])  # the first token of each section
    sec_n = np.diff(np.append(sec_tok, n))
    sec_of = np.repeat(np.arange(sections), sec_n)
    head = np.zeros(n, bool)
    head[1:] = cls[:-1] == NEWLINE
    head[sec_tok[full]] = True
    line_tok = np.flatnonzero(head)  # the first token of each line
    lines = len(line_tok)
    line_of = np.cumsum(head) - 1
    line_n = np.diff(np.append(line_tok, n))
    line_sec = sec_of[line_tok]
    sec_line = np.searchsorted(line_tok, sec_tok)
    sec_lines = np.diff(np.append(sec_line, lines))
    missing = np.zeros(sections, bool)
    missing[full] = cls[(sec_tok + sec_n - 1)[full]] != NEWLINE
    missed = np.cumsum(missing) - missing
    # Places among all elements: what stands before, of tokens, lines, turns, roots and missing tokens.
    shift = turns * (np.arange(sections) + 1) + tree_of + 1 + missed
    p_tok = np.arange(n) + line_of + 1 + shift[sec_of]
    p_line = line_tok + np.arange(lines) + shift[line_sec]
    p_turn = sec_tok + sec_line + shift - 1
    first_sec = np.searchsorted(tree_of, np.arange(trees))
    p_root = np.append(sec_tok, n)[first_sec] + np.append(sec_line, lines)[first_sec] + turns * first_sec + np.arange(trees) + np.append(missed, missing.sum())[first_sec]
    gone = np.flatnonzero(missing)
    p_gone = p_tok[(sec_tok + sec_n - 1)[gone]] + 1
    total = n + lines + turns * sections + trees + len(gone)
    sizes = np.diff(np.append(p_root, total))
    tree = np.repeat(np.arange(trees), sizes)
    base = np.repeat(p_root, sizes)
    place = np.arange(total)

    def column(kind, tokens, of_lines, of_turns, roots, of_gone):
        out = np.empty(total, kind)
        out[p_tok], out[p_line], out[p_root], out[p_gone] = tokens, of_lines, roots, of_gone
        if turns:
            out[p_turn] = of_turns
        return out

    gone_line = sec_line[gone] + sec_lines[gone] - 1  # a missing newline stands in its section's last line
    line_gone = np.zeros(lines, np.int64)
    line_gone[gone_line] = 1
    last_of = p_tok[line_tok + line_n - 1] + line_gone if lines else np.zeros(0, np.int64)
    sec_size = sec_n + sec_lines + missing + turns
    last = column(np.int64, p_tok, last_of, p_turn + sec_size - 1, p_root + sizes - 1, p_gone) - base
    up = column(np.int64, p_line[line_of], p_turn[line_sec] if turns else p_root[tree_of[line_sec]], p_root[tree_of], 0, p_line[gone_line])
    parent = np.where(place == base, -1, up - base)
    at = column(np.int64, tok, tok[line_tok], off[:-1], np.append(off[:-1], size)[first_sec], off[1:][gone])
    tok_end = np.append(tok[1:], size) if n else tok
    line_end = np.append(tok, size)[line_tok + line_n]
    tree_end = np.append(off[:-1], size)[np.append(first_sec[1:], sections)] if trees else first_sec
    end = column(np.int64, tok_end, line_end, off[1:], tree_end, off[1:][gone])
    origin = at[base]
    turn_slot = np.arange(sections) - first_sec[tree_of] if sections else np.zeros(0, np.int64)
    line_slot = np.arange(lines) - sec_line[line_sec]
    tree_n = np.bincount(tree_of, minlength=trees) if turns else np.bincount(tree_of[line_sec], minlength=trees)
    depth = column(np.int32, level + 1, level, 1, 0, level + 1)
    is_node = depth <= level
    storage = column(np.int8, np.where(cls == NEWLINE, 1, 2), 0, 0, 0, 3)
    return forest.Rows(ids, tree, {
        "pre": place - base, "last": last, "parent_pre": parent,
        "slot": lambda: column(np.int32, np.arange(n) - line_tok[line_of], line_slot, turn_slot, 0, line_n[gone_line]),
        "node_slot": lambda: column(np.int32, -1, line_slot, turn_slot, -1, -1),
        "depth": depth, "is_node": is_node,
        "kind": column(np.int64, KINDS[cls], TEXT["line"], TEXT["turn"], TEXT["root"], TEXT["newline"]),
        "start": at - origin, "end": end - origin,
        "child_count": lambda: column(np.int32, 0, line_n + line_gone, sec_lines, tree_n, 0),
        "node_child_count": lambda: column(np.int32, 0, 0, sec_lines, tree_n, 0),
        "storage": lambda: pa.array(STORAGES).take(pa.array(storage)),
        "text": lambda: texts_at(data, np.append(at, size), is_node),
    })
