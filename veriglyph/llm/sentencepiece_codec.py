"""Operator 9, SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut before each run of spaces; its distinct parts are laid end to end and their suffixes sorted, as
far as the longest piece reaches. Binary search of every piece gives the range of suffixes that begin with it, so all its
occurrences. Each is an edge from its first to its last byte. The edges, sorted by where they end, are relaxed from left
to right: an edge is taken if the best token before it and its own piece would not be merged across their border.

The model merges pairs of tokens (BPE), so the best path isn't one of largest sum: *relaxing* here tests that pair. Exactly one
edge passes at each border of characters, which makes the path the same as that of merging by score. The test replays
the borders of two tokens backwards in merging order; results are kept in a table of fixed size.

``path`` names a model file whose pieces have spaces at their start only, with byte fallback and no other normalization
than a space before the text, as in ``piece_bpe_32k.model``. A piece's spaces are U+2581. Files are read on the driver.

Defined results: null text has null ids, count and hashes; empty text has none; characters without a piece become their bytes' pieces;
U+2581 in a text decodes as a space; repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rolling import buffers, chunks, exact_numbers, range_codes, trim

#: Bytes of distinct parts indexed at a time, parts relaxed one by one beyond so many bytes, and cached borders.
INDEX, LONG, CACHE = 1 << 18, 96, 1 << 20
_NEVER = np.int64(1) << np.int64(40)


def default_path() -> str:
    """The public model's file, where that package is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces in merging order: single characters first, then by score; ``split`` undoes a piece's last merge."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(k, model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]
        self.byte_ids = np.full(256, -1, np.int32)
        self.output = [b""] * len(pieces)
        normal = []
        for k, piece, score in pieces:
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.output[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                text = piece.replace("▁", " ")
                if " " in text.lstrip(" ") or (text.startswith("  ") and text.strip(" ")):
                    raise ValueError("pieces must have a space at their start only")
                normal.append((k, text, score))
                self.output[k] = text.encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the model must have a piece for each byte")
        self.runs = {len(t): k for k, t, _ in normal if not t.strip(" ")}
        self.run_scores = {len(t): s for k, t, s in normal if not t.strip(" ")}
        plain = [x for x in normal if len(x[1]) == 1] + sorted((x for x in normal if len(x[1]) > 1 and x[1].strip(" ")), key=lambda x: -x[2])
        number = {t: n for n, (_, t, _) in enumerate(plain)}
        singles = sum(len(t) == 1 for t in number)
        left, right = np.arange(len(plain)), np.arange(len(plain))
        ok = np.ones(len(plain), dtype=bool)
        for n, (_, text, _) in enumerate(plain[singles:], singles):
            parts = list(text)
            while len(parts) > 2:
                best, at = min(((number.get(a + b, n), i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True))), default=(n, 0))
                if best >= n:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ok[n] = len(parts) == 2 and all(p in number and number[p] < n for p in parts)
            if ok[n]:
                left[n], right[n] = (number[p] for p in parts)
        self.ids = np.array([k for k, _, _ in plain], np.int32)
        self.left, self.right, self.singles = left, right, singles
        encoded = [t.encode() for _, t, _ in plain]
        self.length = np.array([len(x) for x in encoded], np.int64)
        usable = [n for n in range(len(plain)) if ok[n]]
        usable.sort(key=lambda n: encoded[n])
        self.usable = np.array(usable)
        self.width = -(-max(map(len, encoded)) // 8) * 8
        self.low = np.array([encoded[n].ljust(self.width, b"\0") for n in usable], f"S{self.width}")
        self.high = np.array([encoded[n].ljust(self.width, b"\xff") for n in usable], f"S{self.width}")
        pairs = sorted((number[t[:k]] * (len(plain) + 1) + number[t[k:]], n) for t, n in number.items() for k in range(1, len(t)) if t[:k] in number and t[k:] in number)
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.unknown = len(plain)  # a character without a piece: never merged
        self.table = np.frombuffer(b"".join(self.output), np.uint8)
        self.table_len = np.array([len(x) for x in self.output], np.int64)
        self.table_at = np.cumsum(self.table_len) - self.table_len

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    @lru_cache(maxsize=256)  # noqa: B019
    def run(self, n: int) -> list[int]:
        """The ids of n spaces: neighbours are merged by score, then from the left, out of a heap."""
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-self.run_scores[2], i, 1, 1) for i in range(n - 1)] if 2 in self.runs else []
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if size[i] != a or j >= n or size[j] != b:  # merged since
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and size[p] + size[q] in self.runs:
                    heappush(heap, (-self.run_scores[size[p] + size[q]], p, size[p], size[q]))
        return [self.runs[s] for s in size if s]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of the piece that a and b make, or a huge one."""
        key = a * (self.unknown + 1) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether adjoining tokens a, b stay apart while both are merged from characters.

        Backwards in time, the younger of the two that meet at the border is undone. They would merge if their own
        piece comes before what ends each of them; of equal pieces the left one comes first.
        """
        out = np.ones(len(a), dtype=bool)
        todo = np.flatnonzero((a != self.unknown) & (b != self.unknown))
        a, b = a[todo], b[todo]
        end_a, end_b = np.full(len(todo), _NEVER), np.full(len(todo), _NEVER)
        while len(todo):
            m = self.merged(a, b)
            bad = (m < end_a) & (m <= end_b) & (m < _NEVER)
            out[todo[bad]] = False
            go = ~bad & ((a >= self.singles) | (b >= self.singles))
            todo, a, b, end_a, end_b = todo[go], a[go], b[go], end_a[go], end_b[go]
            born_a, born_b = np.where(a >= self.singles, a, -1), np.where(b >= self.singles, b, -1)
            second = born_b >= born_a
            end_a, end_b = np.where(second, end_a, a), np.where(second, b, end_b)
            a, b = np.where(second, a, self.right[a]), np.where(second, self.left[b], b)
        return out

    def cached_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_keys"):
            self._keys, self._known = np.full(CACHE, -1, np.int64), np.zeros(CACHE, bool)
        key = a * (self.unknown + 1) + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64) & (CACHE - 1)
        out = self._known[slot]
        miss = np.flatnonzero(self._keys[slot] != key)
        if len(miss):
            _, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
            found = self.apart(a[miss[one]], b[miss[one]])
            out[miss] = found[back]
            self._keys[slot[miss[one]]] = -2  # two new keys may want one slot
            self._keys[slot[miss[one]]], self._known[slot[miss[one]]] = key[miss[one]], found
        return out


def edges(voc: Vocabulary, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, piece number) of every occurrence of every piece, by a suffix array cut at the longest piece."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(voc.width + 8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (n + voc.width, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    columns = [eight[k : n + k] for k in range(0, voc.width, 8)]
    suffixes = np.lexsort(columns[::-1])
    ordered = np.empty((n, len(columns)), ">u8")
    for k, x in enumerate(columns):
        ordered[:, k] = x[suffixes]
    ordered = ordered.view(f"S{voc.width}").ravel()
    lo, hi = np.searchsorted(ordered, voc.low), np.searchsorted(ordered, voc.high)
    count = hi - lo
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return suffixes[at], np.repeat(voc.usable, count)


def relax(voc: Vocabulary, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens (numbers, ``unknown`` for characters without a piece) of parts laid end to end, and the parts' offsets in them."""
    place, piece = edges(voc, text)
    lead = np.flatnonzero((text & 0xC0) != 0x80)
    known = np.zeros(len(text), bool)
    known[place[piece < voc.singles]] = True
    strange = lead[~known[lead]]
    size = np.diff(np.append(lead, len(text)))[~known[lead]]
    length = np.concatenate([voc.length[piece], size])
    place, piece = np.concatenate([place, strange]), np.concatenate([piece, np.full(len(strange), voc.unknown)])
    part = np.searchsorted(bounds, place, side="right") - 1
    inside = place + length <= bounds[part + 1]
    place, piece, length, part = place[inside], piece[inside], length[inside], part[inside]
    asked = bounds
    if np.diff(bounds).max(initial=0) > LONG:
        # no token crosses a border that no edge crosses, nor can tokens merge across it: long parts are cut there
        crossing = np.cumsum(np.bincount(place + 1, minlength=len(text) + 2) - np.bincount(place + length, minlength=len(text) + 2))[: len(text)]
        open_ = lead[crossing[lead] == 0]
        open_ = open_[np.diff(bounds)[np.searchsorted(bounds, open_, side="right") - 1] > LONG]
        bounds = np.union1d(bounds, open_)
        part = np.searchsorted(bounds, place, side="right") - 1
    # slot bounds[p] + p + k stands for the border after k bytes of part p
    start = place + part
    end = start + length
    token, step = np.full(len(text) + len(bounds), -1, np.int64), np.zeros(len(text) + len(bounds), np.int64)
    after = place - bounds[part] + length
    whole = np.diff(bounds)
    slow = whole[part] > LONG
    fast = np.flatnonzero(~slow)
    order = fast[np.argsort(after[fast].astype(np.uint16), kind="stable")]
    cuts = np.searchsorted(after[order], np.arange(1, LONG + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[lo:hi]
        if not len(at):
            continue
        before = token[start[at]]
        first = start[at] == (bounds[part[at]] + part[at])
        ok = first.copy()
        meet = np.flatnonzero(~first & (before >= 0))
        ok[meet] = voc.cached_apart(before[meet], piece[at[meet]])
        at = at[ok]
        token[end[at]], step[end[at]] = piece[at], length[at]
    late = np.flatnonzero(slow)
    late = late[np.argsort(end[late], kind="stable")]
    memo: dict[tuple[int, int], bool] = {}
    for s, e, t, n, f in zip(start[late].tolist(), end[late].tolist(), piece[late].tolist(), length[late].tolist(), (bounds[part[late]] + part[late]).tolist(), strict=True):
        if s != f:
            pair = (int(token[s]), t)
            if pair[0] < 0:
                continue
            if pair not in memo:
                memo[pair] = bool(voc.apart(np.array([pair[0]]), np.array([t]))[0])
            if not memo[pair]:
                continue
        token[e], step[e] = t, n
    back, owner, at = [], np.arange(len(bounds) - 1), bounds[1:] + np.arange(len(bounds) - 1)
    first = bounds[:-1] + np.arange(len(bounds) - 1)
    live = np.flatnonzero(at > first)
    owner, at = owner[live], at[live]
    while len(owner):
        back.append((owner, token[at]))
        at = at - step[at]
        go = at > first[owner]
        owner, at = owner[go], at[go]
    count = np.zeros(len(bounds) - 1, np.int64)
    for o, _ in back:
        count[o] += 1
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(offsets[-1], np.int64)
    for k, (o, t) in enumerate(back):
        out[offsets[o] + count[o] - 1 - k] = t
    return out, offsets[np.searchsorted(bounds, asked)]


def encode_parts(voc: Vocabulary, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of parts (each a run of spaces, then other bytes) laid end to end, and the parts' offsets in them."""
    lone = text == 32
    spaces = np.add.reduceat(lone, bounds[:-1])
    keep = ~lone
    keep[bounds[1:][spaces > 0] - 1] |= False
    last = bounds[:-1] + spaces - 1
    keep[last[spaces > 0]] = True  # a part keeps one space; the others are told by its count
    cut = text[keep]
    kept = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, bounds[:-1]))])
    ids, sizes = [], []
    at = 0
    while at < len(kept) - 1:
        to = max(at + 1, int(np.searchsorted(kept, kept[at] + INDEX, side="right")) - 1)
        part = cut[kept[at] : kept[to]]
        tokens, offsets = relax(voc, part, kept[at : to + 1] - kept[at])
        number = np.append(voc.ids, -1)[tokens]
        size = np.diff(offsets)
        odd = np.flatnonzero((spaces[at:to] > 1) | (np.bincount(np.repeat(np.arange(to - at), size)[number < 0], minlength=to - at) > 0))
        if len(odd):
            pieces = np.split(number, offsets[1:-1])
            for k in odd.tolist():
                pieces[k] = np.array(_spelled(voc, tokens[offsets[k] : offsets[k + 1]], part[kept[at + k] - kept[at] : kept[at + k + 1] - kept[at]].tobytes(), int(spaces[at + k])), np.int64)
            number, size = np.concatenate(pieces), np.array([len(x) for x in pieces])
        ids.append(number.astype(np.int32))
        sizes.append(size)
        at = to
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _spelled(voc: Vocabulary, tokens: np.ndarray, text: bytes, spaces: int) -> list[int]:
    """A part's ids, with strange characters as bytes and its run of spaces in front."""
    out, at = [], 0
    for t in tokens.tolist():
        if t == voc.unknown:
            n = next((k for k in range(1, 5) if at + k >= len(text) or text[at + k] & 0xC0 != 0x80), 1)
            out += voc.byte_ids[list(text[at : at + n])].tolist()
        else:
            n = int(voc.length[t])
            out.append(int(voc.ids[t]))
        at += n
    if spaces > 1:
        lone = out and out[0] == voc.runs[1]
        out = [*voc.run(spaces - 1 + bool(lone)), *out[bool(lone) :]]
    return out


def split(data: np.ndarray, offsets: np.ndarray):
    """Of rows that adjoin in ``data``: their bytes with a space before each, each part's start and end, the rows that aren't
    empty, and the first part of each; none if all are empty."""
    rows = np.diff(offsets)
    some = np.flatnonzero(rows)
    if not len(some):
        return None
    raw = data[offsets[0] : offsets[-1]]
    if b"\xe2\x96\x81" in (text := raw.tobytes()):
        texts = [text[a - offsets[0] : b - offsets[0]].replace(b"\xe2\x96\x81", b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        raw, rows = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    size = rows[some] + 1
    head = np.cumsum(size) - size
    buf = np.full(size.sum(), 32, np.uint8)  # a space before each text
    body = np.ones(len(buf), bool)
    body[head] = False
    buf[body] = raw
    start = buf == 32
    start[1:] &= buf[:-1] != 32
    start[head] = True
    start = np.flatnonzero(start)
    end = np.append(start[1:], len(buf))
    return buf, start, end, some, np.searchsorted(start, head)


class Encoded:
    """A batch's rows, each distinct part matched once; ids are put together for as many rows as are asked for."""

    def __init__(self, voc: Vocabulary, data: np.ndarray, offsets: np.ndarray):
        numbers, lengths, texts, rows = [], [], [], np.zeros(len(offsets) - 1, np.int64)
        known = 0
        for i, j in chunks(offsets):
            got = split(data, offsets[i : j + 1])
            if got is None:
                continue
            buf, start, end, some, first = got
            rows[i + some] = np.diff(np.append(first, len(start)))
            number, one = exact_numbers(buf, start, end, range_codes(buf, start, end))
            numbers.append((number + known).astype(np.int32))
            known += len(one)
            length = (end - start)[one]
            index = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start[one], length)
            lengths.append(length)
            texts.append(buf[index])
        self.words = np.concatenate([[0], np.cumsum(rows)])
        self.ids, self.at, self.part = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)
        if numbers:
            length, text = np.concatenate(lengths), np.concatenate(texts)
            end = np.cumsum(length)
            number, one = exact_numbers(text, end - length, end, range_codes(text, end - length, end))
            length, where = length[one], (end - length)[one]
            index = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(where, length)
            self.ids, self.at = encode_parts(voc, text[index], np.concatenate([[0], np.cumsum(length)]))
            self.part = number.astype(np.int32)[np.concatenate(numbers)]

    def rows(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows i to j, and the rows' offsets in them."""
        part = self.part[self.words[i] : self.words[j]]
        count = (self.at[part + 1] - self.at[part]).astype(np.int32)
        sums = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        index = np.arange(sums[-1], dtype=np.int32) + np.repeat((self.at[part] - sums[:-1]).astype(np.int32), count)
        return self.ids[index], sums[self.words[i : j + 1] - self.words[i]]


def encode_batch(voc: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's rows and the rows' offsets in them."""
    return Encoded(voc, data, offsets).rows(0, len(offsets) - 1)


def decode_batch(voc: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes of rows of ids, and the rows' offsets in them. The space before each text is dropped."""
    size = voc.table_len[ids]
    index = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(voc.table_at[ids], size)
    out, at = voc.table[index], np.concatenate([[0], np.cumsum(size)])[offsets]
    head = at[:-1][at[1:] > at[:-1]]
    head = head[out[head] == 32]
    return np.delete(out, head), at - np.searchsorted(head, at)


def _parts(voc: Vocabulary, column: pa.Array, most: int = 8 << 20):
    """(i, j, ids, offsets) for a column's rows in runs of bounded text, matched a larger run at a time."""
    data, offsets = buffers(column)
    for a, b in chunks(offsets, most):
        made = Encoded(voc, data, offsets[a : b + 1])
        for i, j in chunks(offsets[a : b + 1]):
            yield a + i, a + j, *made.rows(i, j)
        del made
        trim()


def tokenize(docs: DataFrame, path: str | None = None, column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array<int>; replaced if there) for the text ``column``."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    names = [c for c in docs.columns if c != ids]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(names)], *([F.col(f"`{column}`").alias("text_")] if column == ids else []))
    source = "text_" if column == ids else f"c{names.index(column)}"

    def run(batches):
        for batch in batches:
            for i, j, got, at in _parts(shared.value, batch.column(source)):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(got), mask=batch.column(source)[i:j].is_null())
                yield pa.RecordBatch.from_arrays([*(batch.column(f"c{n}")[i:j] for n in range(len(names))), lists], names=[*(f"c{n}" for n in range(len(names))), "ids"])

    kinds = ", ".join(f"c{n} {rows.schema[f'c{n}'].dataType.simpleString()}" for n in range(len(names)))
    return rows.mapInArrow(run, f"{kinds}, ids array<int>").toDF(*names, ids)


def detokenize(rows: DataFrame, path: str | None = None, ids: str = "ids", column: str = "text") -> DataFrame:
    """``rows`` with the text that ``ids`` spell in ``column`` (replaced if there); bytes that are no text become U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    names = [c for c in rows.columns if c != column]
    chosen = rows.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(names)], F.col(f"`{ids}`").cast("array<int>").alias("ids_"))

    def run(batches):
        for batch in batches:
            lists = batch.column("ids_")
            at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
            out, bounds = decode_batch(shared.value, lists.flatten().to_numpy(zero_copy_only=False), at)
            text = out.tobytes()
            got = [text[a:b].decode(errors="replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{n}") for n in range(len(names))), pa.array([t if ok else None for t, ok in zip(got, lists.is_valid().to_pylist(), strict=True)], pa.string())], names=[*(f"c{n}" for n in range(len(names))), "text"])

    kinds = ", ".join(f"c{n} {chosen.schema[f'c{n}'].dataType.simpleString()}" for n in range(len(names)))
    return chosen.mapInArrow(run, f"{kinds}, text string").toDF(*names, column)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256 of 32-bit little-endian ids, decoded_sha256, round_trip: decoding gives the text) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))

    def run(batches):
        for batch in batches:
            doc, null = batch.column("doc_id").to_pylist(), batch.column("text_").is_null().to_pylist()
            data, offsets = buffers(batch.column("text_"))
            for i, j, ids, at in _parts(shared.value, batch.column("text_")):
                out, bounds = decode_batch(shared.value, ids, at)
                text, coded, rows = out.tobytes(), ids.astype("<i4").tobytes(), []
                for r in range(j - i):
                    if null[i + r]:
                        rows.append((doc[i + r], None, None, None, None))
                        continue
                    got = text[bounds[r] : bounds[r + 1]]
                    rows.append((doc[i + r], int(at[r + 1] - at[r]), hashlib.sha256(coded[4 * at[r] : 4 * at[r + 1]]).hexdigest(), hashlib.sha256(got).hexdigest(), got == data[offsets[i + r] : offsets[i + r + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text_"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
