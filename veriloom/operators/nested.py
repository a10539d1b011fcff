"""Nested records to flat child tables that keep the link to their parent.

Nested text goes through a vectorised structural index. Over the bytes of a whole block
of texts, bitmaps of quotes, brackets and delimiters are built; the quote parity masks
what lies inside strings, and what remains is a row of tokens. A prefix sum over the
brackets gives the depth of each token, sorting brackets by depth pairs them, and a
forward fill gives every token the bracket it stands in. Whether a text is JSON is
decided on the same arrays: brackets must pair, each token must fit the one before it,
numbers and words run through a transition table, escapes are looked at byte by byte.
Children, their keys and their fields are then found by comparing these arrays, and
their texts are cut out in one gather. No text is parsed row by row.

Typed columns are written as text by Spark and go the same way; a child table with all
its fields, typed, is exploded by Spark itself (``child_table``).

Defined results: a null or empty parent column has no children; null elements of an
array have no row but keep their place in ``pos``; text that is not valid JSON has no
children, however deep it is nested; of a key given twice the last value counts; extra
columns are never read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that make an object a candidate rather than a holder of candidates.
_OWN = (b"corpus_id", b"page_id", b"sentence_id", b"text", b"provenance")
#: Bytes of text indexed at once; the index takes some sixty times as much for a moment. A longer text is indexed alone.
_BLOCK = 1 << 20
_WS = np.zeros(256, bool)
_WS[[9, 10, 13, 32]] = True
#: Kinds of tokens; a closing bracket is its opening one and 1.
OBJECT, _END_OBJECT, ARRAY, _END_ARRAY, COLON, COMMA, STRING, LITERAL = range(1, 9)
_KIND = np.zeros(256, np.int8)
_KIND[[123, 125, 91, 93, 58, 44]] = range(1, 7)
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
#: Bytes of a number or word that run through the transition table; a longer one is matched by itself.
_WIDE = 24
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """The automaton of numbers and of true, false and null: next state by state and byte (byte 0 stays), and which states end one."""
    table: list[dict[int, int]] = [{}, {}]  # state 0 is dead, 1 the start
    ends: set[int] = set()

    def new() -> int:
        table.append({})
        return len(table) - 1

    for word in (b"true", b"false", b"null"):
        at = 1
        for c in word:
            at = table[at].setdefault(c, len(table))
            if at == len(table):
                table.append({})
        ends.add(at)
    minus, zero, whole, point, fraction, e, sign, power = (new() for _ in range(8))
    digits = range(48, 58)
    table[1][45] = minus
    for state in (1, minus):
        table[state] |= {48: zero} | {d: whole for d in digits if d != 48}
    table[whole] |= {d: whole for d in digits}
    for state in (zero, whole):
        table[state][46] = point
    for state in (point, fraction):
        table[state] |= {d: fraction for d in digits}
    for state in (zero, whole, fraction):
        table[state] |= {69: e, 101: e}
    table[e] |= {43: sign, 45: sign}
    for state in (e, sign, power):
        table[state] |= {d: power for d in digits}
    out = np.zeros((len(table), 256), np.int8)
    for k, row in enumerate(table):
        out[k, 0] = k
        for c, to in row.items():
            out[k, c] = to
    accept = np.zeros(len(table), bool)
    accept[[*ends, zero, whole, fraction, power]] = True
    return out, accept


_NEXT, _ACCEPT = _transitions()


def _shift(a: np.ndarray, same: np.ndarray, by: int = 1) -> np.ndarray:
    """The value of the token ``by`` before, 0 where that is another text's."""
    out = np.zeros_like(a)
    out[by:] = np.where(same[by:] == same[:-by], a[:-by], 0)
    return out


class StructuralIndex:
    """The tokens of a block of texts, as arrays: place, kind, text, depth, the bracket they stand in, where they end; and which texts are valid."""

    def __init__(self, texts: list[bytes]):
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths)
        starts = self.ends - lengths
        buf = self.buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        n = len(buf)
        place = np.arange(n)
        slash = buf == 92
        run = place - np.maximum.accumulate(np.where(slash, -1, place)) if n else place
        escaped = np.zeros(n, bool)
        escaped[1:] = (run[:-1] & 1) == 1
        quote = (buf == 34) & ~escaped
        count = np.cumsum(quote)
        before = np.where(starts > 0, count[starts - 1], 0) if n else starts
        inside = ((count - np.repeat(before, lengths)) & 1) == 1  # the opening quote and all up to the closing one
        structural = (_KIND[buf] > 0) & ~inside
        opening, closing = quote & inside, quote & ~inside
        plain = ~(inside | closing | structural | _WS[buf])
        first = plain.copy()
        first[1:] &= ~plain[:-1]
        at = self.at = np.flatnonzero(structural | opening | first)
        kind = self.kind = np.where(opening[at], STRING, np.where(first[at], LITERAL, _KIND[buf[at]])).astype(np.int8)
        text = self.text = np.searchsorted(self.ends, at, side="right")
        bad = np.zeros(len(texts), np.int64)  # what is wrong with each text
        self._slashes = np.concatenate(([0], np.cumsum(slash)))

        # Where tokens end.
        end = self.end = at + 1
        quotes, stops = np.flatnonzero(quote), np.flatnonzero(plain & ~np.append(plain[1:], False)) + 1
        strings, words = kind == STRING, kind == LITERAL
        follow = np.searchsorted(quotes, at[strings]) + 1
        end[strings] = np.append(quotes, n)[np.minimum(follow, len(quotes))]
        end[words] = stops[np.searchsorted(stops, at[words], side="right")]

        # Depth, pairs of brackets, and the bracket each token stands in.
        opens, closes = (kind == OBJECT) | (kind == ARRAY), (kind == _END_OBJECT) | (kind == _END_ARRAY)
        step = opens.astype(np.int64) - closes
        level = np.cumsum(step)
        lead = np.searchsorted(text, np.arange(len(texts)))
        base = np.where(lead < len(at), (level - step)[np.minimum(lead, max(len(at) - 1, 0))], 0) if len(at) else np.zeros(len(texts), np.int64)
        level = level - base[text]
        holder = self.level = np.where(opens, level - 1, np.where(closes, level + 1, level))  # depth of what a token stands in
        np.add.at(bad, text[(level < 0) | (holder < 0)], 1)
        last = np.searchsorted(text, np.arange(len(texts)), side="right") - 1
        np.add.at(bad, np.flatnonzero((lead > last) | (np.where(last >= 0, level[np.maximum(last, 0)], 0) != 0 if len(at) else True)), 1)
        deep = int(max(level.max(initial=0), 0)) + 2
        cell = text * deep + np.clip(holder, 0, deep - 1)
        mark = np.flatnonzero(opens)
        inner = text[mark] * deep + np.clip(level[mark], 0, deep - 1)
        self.match = np.full(len(at), -1)
        b = np.flatnonzero(opens | closes)
        group = np.where(opens[b], text[b] * deep + np.clip(level[b], 0, deep - 1), cell[b])
        order = np.lexsort((b, group))
        b, group = b[order], group[order]
        rank = np.arange(len(b)) - np.searchsorted(group, group)
        np.add.at(bad, text[b[opens[b] != (rank % 2 == 0)]], 1)
        one = np.flatnonzero((rank[:-1] % 2 == 0) & (group[:-1] == group[1:])) if len(b) else b
        self.match[b[one]] = b[one + 1]
        np.add.at(bad, text[b[one][kind[b[one]] + 1 != kind[b[one + 1]]]], 1)
        every, where = np.concatenate((cell, inner)), np.concatenate((np.arange(len(at)), mark))
        order = np.lexsort((where, every))
        filled = np.maximum.accumulate(np.where(order >= len(at), np.arange(len(order)), -1)) if len(order) else order
        known = (filled >= 0) & (every[order[filled]] == every[order]) if len(order) else np.zeros(0, bool)
        parent = np.full(len(order), -1)
        parent[order] = np.where(known, where[order[filled]], -1) if len(order) else -1
        self.parent = parent[: len(at)]

        # What may follow what.
        within = np.where(self.parent >= 0, kind[self.parent], 0) if len(at) else kind
        prev = _shift(kind, text)
        in_object, in_array = within == OBJECT, within == ARRAY
        self.key = strings & in_object & ((prev == OBJECT) | (prev == COMMA))
        value = self.value = (opens | strings | words) & ~self.key
        whole = closes | words | (strings & ~self.key)
        after = _shift(whole.astype(np.int8), text) == 1
        fits = np.where(value, (in_object & (prev == COLON)) | (in_array & ((prev == ARRAY) | (prev == COMMA))) | ((holder == 0) & (prev == 0)), True)
        fits &= np.where(kind == COLON, in_object & (_shift(self.key.astype(np.int8), text) == 1), True)
        fits &= np.where(kind == COMMA, (in_object | in_array) & after, True)
        fits &= np.where(closes, after | (prev == kind - 1), True)
        np.add.at(bad, text[~fits], 1)

        # Numbers and words, characters and escapes.
        np.add.at(bad, text[words][~self._literals(at[words], end[words])], 1)
        of = lambda places: np.searchsorted(self.ends, places, side="right")
        np.add.at(bad, of(np.flatnonzero((buf == 0) | (inside & (buf < 32)))), 1)
        np.add.at(bad, np.flatnonzero((np.diff(np.concatenate(([0], count[self.ends - 1] if n else []))) & 1) == 1), 1)
        marks = np.flatnonzero(slash & inside & ~escaped)
        np.add.at(bad, of(marks[~_ESCAPES[buf[marks + 1]]]), 1)
        codes = marks[buf[marks + 1] == 117]
        for k in range(2, 6):
            np.add.at(bad, of(codes[~_HEX[buf[np.minimum(codes + k, n - 1)]]]), 1)
        self.valid = bad == 0
        self.null = words & (buf[at] == 110) if len(at) else words

    def _literals(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - at
        state = np.ones(len(at), np.int8)
        for k in range(min(_WIDE, int(size.max(initial=0)))):
            c = self.buf[np.minimum(at + k, len(self.buf) - 1)]
            state = _NEXT[state, np.where(k < size, c, 0)]
        good = _ACCEPT[state]
        for k in np.flatnonzero(size > _WIDE).tolist():
            good[k] = _NUMBER.fullmatch(self.buf[at[k] : end[k]].tobytes()) is not None
        return good

    def keys(self, name: bytes) -> np.ndarray:
        """Tokens that are keys of this name, of valid texts."""
        hit = np.flatnonzero(self.key & (self.end - self.at == len(name) + 1) & self.valid[self.text])
        for j, c in enumerate(name):
            hit = hit[self.buf[self.at[hit] + 1 + j] == c]
        return hit

    def strings(self, tokens: np.ndarray) -> pa.Array:
        """The scalars at the tokens as text, cut out in one gather; null and nested values, and tokens below 0, give null."""
        if not len(self.at):
            return pa.nulls(len(tokens), pa.string())
        kind = self.kind[tokens]
        there = (tokens >= 0) & ((kind == STRING) | (kind == LITERAL)) & ~self.null[tokens]
        start = self.at[tokens] + (kind == STRING)
        size = np.where(there, self.end[tokens] - start, 0)
        offsets = np.concatenate(([0], np.cumsum(size)))
        gather = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
        mask = pa.py_buffer(np.packbits(there, bitorder="little").tobytes())
        out = pa.StringArray.from_buffers(len(tokens), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(self.buf[gather].tobytes()), mask)
        marked = np.flatnonzero(there & (kind == STRING) & (self._slashes[start + size] > self._slashes[np.minimum(start, start + size)]))
        if len(marked):  # escapes are few
            plain = out.to_pylist()
            for k in marked.tolist():
                plain[k] = json.loads(b'"%s"' % self.buf[start[k] : start[k] + size[k]].tobytes(), strict=False).encode("utf-8", "replace").decode()
            out = pa.array(plain, pa.string())
        return out

    def elements(self, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of arrays (tokens) the root and the token of every element; those of arrays within arrays stand in their place."""
        root = np.full(len(self.at), -1)
        root[roots] = roots
        inner = np.flatnonzero((self.kind == ARRAY) & self.value)
        while len(inner):  # arrays within arrays, a level at a time
            into = self.parent[inner]
            step = (into >= 0) & (self.kind[into] == ARRAY) & (root[into] >= 0) & (root[inner] < 0)
            if not step.any():
                break
            root[inner[step]] = root[into[step]]
            inner = inner[~step]
        tokens = np.flatnonzero(self.value & (self.parent >= 0) & (self.kind != ARRAY))
        tokens = tokens[(root[self.parent[tokens]] >= 0) & (self.kind[self.parent[tokens]] == ARRAY)]
        return root[self.parent[tokens]], tokens


def valid_json(text: bytes) -> bool:
    return bool(StructuralIndex([text]).valid[0])


class Children:
    """The children that ``field`` holds in each text: number of the text, place and token, in order.

    The outermost ``field`` of a text counts, of several the last. An array's elements are
    the children, an object itself if it has a field of a candidate, or what all its
    arrays hold, else its objects. A string value is read as JSON text again: ``again``
    has the numbers and texts of those.
    """

    def __init__(self, ix: StructuralIndex, field: bytes):
        self.ix = ix
        hit = ix.keys(field)
        order = np.lexsort((-hit, ix.level[hit], ix.text[hit]))
        hit = hit[order]
        hit = hit[np.concatenate(([True], ix.text[hit][1:] != ix.text[hit][:-1]))] if len(hit) else hit
        held = hit + 2  # key, colon, value
        kind = ix.kind[held]
        objects = held[kind == OBJECT]
        own = np.unique(np.concatenate([ix.parent[ix.keys(n)] for n in _OWN]))
        single = objects[np.isin(objects, own)]
        holders = objects[~np.isin(objects, own)]
        inside = np.flatnonzero(ix.value & np.isin(ix.parent, holders)) if len(holders) else held[:0]
        arrays, parts = inside[ix.kind[inside] == ARRAY], inside[ix.kind[inside] == OBJECT]
        parts = parts[~np.isin(ix.parent[parts], ix.parent[arrays])]
        roots = np.concatenate((held[kind == ARRAY], arrays))
        _, elements = ix.elements(roots) if len(roots) else (None, held[:0])
        token = np.sort(np.concatenate((elements, single, parts)))
        text = ix.text[token]
        pos = np.arange(len(token)) - np.searchsorted(text, text)
        kept = ~ix.null[token]
        self.token, self.text, self.pos = token[kept], text[kept], pos[kept]
        strings = held[kind == STRING]
        self.again = list(zip(ix.text[strings].tolist(), ix.strings(strings).to_pylist()))

    def fields(self, names: list[bytes], most: int | None = None, typed: bool = True) -> list[np.ndarray]:
        """For each name the token of that field within each child, -1 if there is none: of those at most ``most`` objects deep and not null the outermost, of several the last."""
        ix = self.ix
        number = np.full(len(ix.at) + 1, -1)
        number[self.token[ix.kind[self.token] == OBJECT]] = np.flatnonzero(ix.kind[self.token] == OBJECT)
        out = []
        for name in names:
            key = ix.keys(name)
            at, depth, child = ix.parent[key], np.zeros(len(key), np.int64), np.full(len(key), -1)
            while True:
                new = (child < 0) & (at >= 0)
                if not new.any() or (most is not None and depth.max(initial=0) > most):
                    break
                child = np.where(new, number[at], child)
                go = (child < 0) & (at >= 0)
                depth += go
                if most is not None:  # only objects that stand directly in one another count
                    go &= ix.kind[at] == OBJECT
                at = np.where(go, ix.parent[at], np.where(child < 0, -1, at))
            value = key + 2
            good = (child >= 0) & ((ix.kind[value] == STRING) | (ix.kind[value] == LITERAL)) & ~ix.null[value]
            if most is not None:
                good &= depth <= most
            key, depth, child = key[good], depth[good], child[good]
            order = np.lexsort((key, -depth))  # outermost and last is written last
            found = np.full(len(self.token), -1)
            found[child[order]] = key[order] + 2
            out.append(found)
        return out

    def identity(self) -> pa.Array:
        """corpus_id of each child, else page_id::sentence_id, in it or one object deeper; a scalar child is its own key."""
        ix = self.ix
        corpus, page, sentence = (ix.strings(t) for t in self.fields([b"corpus_id", b"page_id", b"sentence_id"], 1))
        named = pc.if_else(pc.equal(corpus, ""), pa.scalar(None, pa.string()), corpus)
        pair = pc.binary_join_element_wise(page, sentence, "::")
        scalar = np.where(ix.kind[self.token] == OBJECT, -1, self.token)
        return pc.coalesce(named, pair, ix.strings(scalar))


def _gathered(texts: list[bytes], field: bytes, read) -> list[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
    """Parts of (text, pos, columns) of all children; ``read`` makes the columns of a ``Children``."""
    if not texts:
        return []
    found = Children(StructuralIndex(texts), field)
    parts = [(found.text, found.pos, read(found))]
    if found.again:
        back = np.array([d for d, _ in found.again])
        for text, pos, columns in _gathered([b'{"%s":%s}' % (field, t.encode("utf-8", "replace")) for _, t in found.again], field, read):
            parts.append((back[text], pos, columns))
    return parts


def json_children(texts: list[bytes], field: bytes) -> list[tuple[int, int, str | None]]:
    """(number of the text, place, key) of each non-null child that ``field`` holds in these texts; those that are not valid JSON have none."""
    return [row for text, pos, (key,) in _gathered(texts, field, lambda c: [c.identity()]) for row in zip(text.tolist(), pos.tolist(), key.to_pylist())]


def _blocks(raw: pa.Array) -> Iterator[list[int]]:
    """Places of the texts, in blocks of bounded size."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(raw), -1))
    block, size = [], 0
    for i in np.flatnonzero(sizes > 0).tolist():
        if block and size + sizes[i] > _BLOCK:
            yield block
            block, size = [], 0
        block.append(i)
        size += sizes[i]
    if block:
        yield block


def _exploded(df: DataFrame, parent_id: str, payload: Column, field: str, columns: dict[str, str], read) -> DataFrame:
    """parent_id, pos and ``columns`` of the children in a JSON text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0), batch.column(1).cast(pa.binary())
            for block in _blocks(raw):
                places = np.array(block)
                for text, pos, found in _gathered([raw[i].as_py() for i in block], field.encode(), read):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(places[text])), pa.array(pos, pa.int64()), *found], names=["parent_id", "pos", *columns])

    narrow = df.select(F.col(parent_id).cast("long").alias("parent_id"), payload.alias("payload"))
    return narrow.mapInArrow(run, "parent_id long, pos long, " + ", ".join(f"`{n}` {t}" for n, t in columns.items()))


def explode_json(df: DataFrame, parent_id: str, payload: str, field: str) -> DataFrame:
    """Children of ``field`` in the JSON text column ``payload``: parent_id, pos, child_key."""
    return _exploded(df, parent_id, F.col(payload), field, {"child_key": "string"}, lambda c: [c.identity()])


def explode_json_fields(df: DataFrame, parent_id: str, payload: str, field: str, names: list[str]) -> DataFrame:
    """The flat child table of ``field`` in a JSON text column: parent_id, pos and the named scalars as text, however deep; of those that are not null the outermost counts."""
    wanted = [n.encode() for n in names]
    return _exploded(df, parent_id, F.col(payload), field, dict.fromkeys(names, "string"), lambda c: [c.ix.strings(t) for t in c.fields(wanted)])


def _scalars(found: Children) -> list[pa.Array]:
    """Second-level rows: (child, holder, name, value) of every scalar field of the objects that a child holds, with the holder's path."""
    ix = found.ix
    number = np.full(len(ix.at) + 1, -1)
    number[found.token] = np.arange(len(found.token))
    key = np.flatnonzero(ix.key & ix.valid[ix.text])
    value = key + 2
    good = ((ix.kind[value] == STRING) | (ix.kind[value] == LITERAL)) & ~ix.null[value]
    key = key[good]
    path = pa.nulls(len(key), pa.string())
    at, child = ix.parent[key], np.full(len(key), -1)
    child = np.where(at >= 0, number[at], -1)
    direct = child >= 0  # fields of the child itself are its own columns
    at = np.where(direct, -1, at)
    while (at >= 0).any():
        name = np.where((at >= 2) & (ix.kind[at] == OBJECT), at - 2, -1)  # the key whose value the object is
        name = np.where((name >= 0) & ix.key[name], name, -1)
        step = ix.strings(name)
        path = pc.if_else(pc.is_valid(step), pc.coalesce(pc.binary_join_element_wise(step, path, "."), step), path)
        at = np.where(name >= 0, ix.parent[at], -1)
        child = np.where((at >= 0) & (child < 0), number[at], child)
        at = np.where(child >= 0, -1, at)
    keep = np.flatnonzero((child >= 0) & ~direct)
    return [child[keep], path.take(pa.array(keep)), ix.strings(key[keep]), ix.strings(key[keep] + 2)]


def explode_json_nested(df: DataFrame, parent_id: str, payload: str, field: str) -> DataFrame:
    """The table below the children of ``field``: parent_id, pos (the link to the child), holder (path of the nested object), name and value of each scalar in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0), batch.column(1).cast(pa.binary())
            for block in _blocks(raw):
                places = np.array(block)
                for text, pos, (rows,) in _gathered([raw[i].as_py() for i in block], field.encode(), lambda c: [_scalars(c)]):
                    child, holder, name, value = rows
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(places[text[child]])), pa.array(pos[child], pa.int64()), holder, name, value], names=["parent_id", "pos", "holder", "name", "value"])

    narrow = df.select(F.col(parent_id).cast("long").alias("parent_id"), F.col(payload).alias("payload"))
    return narrow.mapInArrow(run, "parent_id long, pos long, holder string, name string, value string")


def explode_columns(df: DataFrame, parent_id: str, lists: list[str], structs: list[str]) -> DataFrame:
    """Children of typed columns by way of their text: parent_id, child, pos, child_key.

    Items of the array or struct columns in ``lists`` are children by their identity, the
    non-null fields of the struct columns in ``structs`` by their name, at pos 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["parent_id", "child", "pos", "child_key"]
        for batch in batches:
            ids, raw = batch.column(0), batch.column(1).cast(pa.binary())
            for block in _blocks(raw):
                places = np.array(block)
                ix = StructuralIndex([raw[i].as_py() for i in block])
                for child in lists:
                    found = Children(ix, child.encode())
                    own = ids.take(pa.array(places[found.text]))
                    yield pa.RecordBatch.from_arrays([own, pa.array([child] * len(own), pa.string()), pa.array(found.pos, pa.int64()), found.identity()], names=names)
                for child in structs:
                    top = ix.keys(child.encode())
                    top = top[ix.level[top] == 1] + 2
                    field = np.flatnonzero(ix.key & np.isin(ix.parent, top))
                    field = field[~ix.null[field + 2]]
                    own = ids.take(pa.array(places[ix.text[field]]))
                    yield pa.RecordBatch.from_arrays([own, pa.array([child] * len(own), pa.string()), pa.array(np.zeros(len(own), np.int64)), ix.strings(field)], names=names)

    text = F.to_json(F.struct(*lists, *structs), {"ignoreNullFields": "false"})
    narrow = df.select(F.col(parent_id).cast("long").alias("parent_id"), text.alias("payload"))
    return narrow.mapInArrow(run, "parent_id long, child string, pos long, child_key string")


def child_table(df: DataFrame, parent_id: str, array: str, prefix: str = "child_") -> DataFrame:
    """All fields of the elements of an array of structs, flat; names get a prefix where they clash with the parent's id."""
    fields = df.schema[array].dataType.elementType.fieldNames()
    rows = df.select(F.col(parent_id), F.posexplode(F.col(array)).alias("pos", "_child")).filter(F.col("_child").isNotNull())
    return rows.select(parent_id, F.col("pos").cast("long").alias("pos"), *[F.col("_child")[f].alias(prefix + f if f in (parent_id, "pos") else f) for f in fields])


def linked_children(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """All child rows of attempt and pipeline records, linked to their parent."""
    typed = explode_columns(attempts, "attempt_id", ["evidence", "selected_evidence"], ["latency"])
    texts = explode_json(results, "result_id", "payload", "verified_candidates")
    first = typed.select(F.lit("attempt_records").alias("parent_table"), "parent_id", "child", "pos", "child_key")
    return first.unionAll(texts.select(F.lit("pipeline_results").alias("parent_table"), "parent_id", F.lit("verified_candidate").alias("child"), "pos", "child_key"))
