"""SentencePiece encoding and decoding: best segmentation by summed piece
scores (Viterbi over a unigram lattice), as a max-plus scan over chunks.

A text is written as SentencePiece does: a space in front, spaces as U+2581,
nothing removed. Each position is an edge's end, each piece an edge; the best
path has the largest sum of scores. A character that no piece covers costs the
lowest score less 10 and becomes its UTF-8 byte pieces.

Texts of up to ``chunk`` characters are one chunk. Longer ones are split; the
state at a chunk border is how far the piece over the border reaches beyond it
(0 to longest piece - 1). A chunk yields the matrix of best scores from every
entry state to every exit state. Matrices of one text are combined in max-plus
algebra, associatively, in a tree of groups of at most ``fan_in`` chunks, the
border states are read off on the way down, and every chunk is traced back on
its own. So one giant text is many tasks.

Scores are whole numbers (score * 2^32) plus a small term for each piece border,
drawn from its distance to the start of the word: it settles ties. Sums are
exact and the result does not depend on the chunking. A matrix counts up to a
constant only (max-plus projective), so its largest entry is moved to 0.

Defined results: null and empty texts have no pieces; U+2581 itself is encoded
by its bytes, so decode(encode(text)) is the text, always; repeated rows come
back as often as they were given; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import weakref
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlekit.llm.common import row_key, shipped, written
from settlekit.llm.textvec import mix

SPACE, OWN_SPACE = "▁", "\ud800"  # a lone surrogate stands for U+2581 in the text itself
FAR = -(1 << 60)  # in matrices: no path
NEVER = float("-inf")
BORDER = (mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) >> np.uint64(48)).astype(int).tolist()  # 16 bits by distance
CHUNK, FAN_IN, CACHED = 32_768, 64, 150_000
#: Bytes of texts (or ids) encoded or decoded at once, characters of new words
#: segmented at once (about 200 bytes of lattice each).
PART, TOGETHER = 3 << 19, 1 << 15


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


_ALL = r"(?s:.+)"


def _word_pattern(pieces) -> str:
    """Pattern of the stretches between borders that no piece crosses.

    Where no piece holds two characters next to each other, a piece border
    stands between them. That is so before a space that follows anything else,
    and before most punctuation that follows a letter or digit: these marks cut
    the text finely, and the pieces tell which they are."""
    before: dict[str, set] = {"\n": set()}  # what comes before a character within a piece
    for t in pieces:
        before.setdefault(t[0], set())
        for a, b in zip(t, t[1:]):
            before.setdefault(b, set()).add(a)
    if before.get(SPACE, set()) - {SPACE}:
        return _ALL
    marks = {c for c in before if not c.isalnum() and c != SPACE and not any(x.isalpha() for x in before[c])}
    joints = {x for c in marks for x in before[c]} - marks - {SPACE}  # marks may go on after these
    group = lambda cs: "[" + "".join(map(re.escape, sorted(cs))) + "]"
    rest = "[^" + group(marks | joints | {SPACE})[1:]
    tail = f"(?:{rest}+|{group(joints)}+{group(marks)}*)" if joints else f"{rest}+"
    return f"{SPACE}+{group(marks)}*{tail}*|{group(marks)}+{tail}*|{tail}+"


class _Words(dict):
    """Segmentations of words, as they come: the recent ones stay. When full,
    the younger half becomes the older one and the older half is let go. ``make``
    is a method of the vocabulary, which it does not keep alive: a vocabulary in
    no cycle goes with its task, not with a later collection of a reused worker."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = weakref.WeakMethod(make), {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.make()(word)
        if len(word) <= 64:
            self.trim()
            self[word] = got
        return got

    def trim(self) -> None:
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()


class Vocabulary:
    """Pieces and scores of a model: a fixed-size table sent to every task."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces by id: (text, score, kind); kind is normal, byte or other."""
        self.pieces = pieces
        self._ready = False

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if p.is_byte(i) else "other" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "normal"
        return cls([(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.vocab_size())])

    def __getstate__(self):
        return {"pieces": self.pieces, "_ready": False}

    def prepare(self) -> Vocabulary:
        if self._ready:
            return self
        self.prepare_decoding()
        normal = {t: i for i, (t, _, kind) in enumerate(self.pieces) if kind == "normal"}
        self.byte_ids = {int(t[3:-1], 16): i for i, (t, _, kind) in enumerate(self.pieces) if kind == "byte"}
        # prohibitive scores (-1e9) still lose against any other way over one piece's length
        whole = lambda score: int(round(max(score, -float(1 << 20)) * 65536)) << 16
        self.weight = {t: whole(self.pieces[i][1]) for t, i in normal.items()}
        self.ids = normal
        self.unknown = min(self.weight.values()) - (10 << 32)
        self.longest = max(map(len, normal))
        self.trie: dict = {}  # by character; the empty text leads to the weight
        for t, w in self.weight.items():
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = w
        self.word = re.compile(_word_pattern(normal))
        # the same at spaces and line breaks only: a quicker pattern for what is looked up
        plain = self.word.pattern != _ALL and not any("\n" in t[1:] or t[:1] == "\n" != t for t in normal)
        self.spaced = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if plain else _ALL)
        # letters stay together, full stops and commas come off: quicker than the pattern
        self.by_letters = self.word.findall(f"{SPACE}ab.{SPACE}é,") == [f"{SPACE}ab", ".", f"{SPACE}é", ","] and self.word.findall("(ab") == ["(ab"]
        self.cache = _Words(self._spelt)
        self._ready = True
        return self

    def prepare_decoding(self) -> Vocabulary:
        """The bytes of each piece: all that decoding needs."""
        spell = lambda t, kind: bytes([int(t[3:-1], 16)]) if kind == "byte" else t.replace(SPACE, " ").encode() if kind == "normal" else b""
        self.spelt = pa.array([spell(t, kind) for t, _, kind in self.pieces], pa.large_binary())
        return self

    # one word or stretch of text -----------------------------------------

    def distances(self, x: str, back: int = 0) -> list[int]:
        """For each border of x its distance to the start of its word; x starts
        ``back`` characters into one."""
        out, start = [0] * (len(x) + 1), -back
        for m in self.word.finditer(x):
            if m.start():
                start = m.start()
            for i in range(m.start(), m.end()):
                out[i] = i - start
        out[len(x)] = len(x) - start
        return out

    def best(self, x: str, begin: int, last_start: int, distance) -> tuple[list, list[int]]:
        """Best score to every position from ``begin``, over pieces that start
        before ``last_start``, and where the last piece starts."""
        trie, unknown, n = self.trie, self.unknown, len(x)
        score, back = [NEVER] * (n + 1), [0] * (n + 1)
        score[begin] = 0
        for i in range(begin, min(last_start, n)):
            here = score[i]
            if here == NEVER:
                continue
            here += BORDER[distance[i] & 65535]
            node = trie.get(x[i])
            j = i + 1
            if node is None or "" not in node:
                if here + unknown > score[j]:
                    score[j], back[j] = here + unknown, i
            while node is not None:
                w = node.get("")
                if w is not None and here + w > score[j]:
                    score[j], back[j] = here + w, i
                if j == n:
                    break
                node = node.get(x[j])
                j += 1
        return score, back

    def ids_back(self, x: str, back: list[int], begin: int, end: int) -> bytes:
        out, ids = [], self.ids
        while end > begin:
            i = back[end]
            s = x[i:end]
            got = ids.get(s)
            if got is not None:
                out.append(got)
            else:
                raw = (SPACE if s == OWN_SPACE else s).encode("utf-8", "surrogatepass")
                out += [self.byte_ids[b] for b in reversed(raw)]
            end = i
        out.reverse()
        return array("i", out).tobytes()

    def _segment(self, word: str) -> bytes:
        if word in self.ids and len(word) == 1:
            return array("i", [self.ids[word]]).tobytes()
        _, back = self.best(word, 0, len(word), range(len(word) + 1))
        return self.ids_back(word, back, 0, len(word))

    def stretches(self, spaced: str) -> list[str]:
        """The parts of a spaced word between sure borders (as ``word`` cuts them)."""
        if self.by_letters:
            if spaced[1:].isalpha():
                return [spaced]
            if spaced[-1] in ".," and spaced[1:-1].isalpha():
                return [spaced[:-1], spaced[-1]]
        return self.word.findall(spaced)

    def _spelt(self, spaced: str) -> bytes:
        return b"".join(map(self._segment, self.stretches(spaced)))

    def encode(self, x: str) -> bytes:
        """Piece ids (int32) of a written text that starts and ends at piece borders."""
        return b"".join(map(self.cache.__getitem__, self.spaced.findall(x)))

    def encode_many(self, texts: list[str]) -> pa.ListArray:
        """Piece ids of a batch of written texts: each distinct word is looked up
        once, new ones are segmented together, and Arrow lays the ids out."""
        words = [self.spaced.findall(x) for x in texts]
        ends = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        flat = list(chain.from_iterable(words))
        del words
        try:
            coded = pa.array(flat, pa.string()).dictionary_encode()
            distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices
        except UnicodeEncodeError:   # a text holds U+2581 itself
            seen: dict[str, int] = {}
            codes = pa.array([seen.setdefault(w, len(seen)) for w in flat], pa.int32())
            distinct = list(seen)
        del flat
        cache, older = self.cache, self.cache.older
        table = [cache.get(w) for w in distinct]
        if older:
            table = [older.get(w) if got is None else got for w, got in zip(distinct, table)]
        new = [i for i, got in enumerate(table) if got is None]
        stretches = [self.stretches(distinct[i]) for i in new]
        known: dict[str, bytes] = {}
        part, size = [], 0
        for x in set().union(*stretches):
            part.append(x)
            size += len(x)
            if size >= TOGETHER:
                known.update(zip(part, self.segment_many(part)))
                part, size = [], 0
        if part:
            known.update(zip(part, self.segment_many(part)))
        for i, s in zip(new, stretches):
            table[i] = known[s[0]] if len(s) == 1 else b"".join(map(known.__getitem__, s))
        cache.trim()
        cache.update((distinct[i], table[i]) for i in new if len(distinct[i]) <= 64)
        laid = _lists(table).take(codes)
        return pa.ListArray.from_arrays(laid.offsets.take(pa.array(ends)), laid.values)

    def _prepare_many(self) -> None:
        """The trie as a hash table of (node, character) -> node, for numpy."""
        nodes, texts, weights, edges, todo = [self.trie], [""], [0], [], [0]
        for at in todo:
            for c, child in nodes[at].items():
                if c:
                    edges.append((at, ord(c), len(nodes)))
                    todo.append(len(nodes))
                    nodes.append(child)
                    texts.append(texts[at] + c)
                    weights.append(child.get("", FAR))
        self.node_piece = np.array([self.ids.get(t, -1) for t in texts], np.int32)
        self.node_weight = np.array(weights, np.int64)
        key = np.array([n << 21 | c for n, c, _ in edges], np.uint64)
        child = np.array([x for _, _, x in edges], np.int32)
        bits = max(4, int(len(edges) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.children = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        slot, left, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(left):  # open addressing: who finds a slot taken tries the next
            at = slot[left]
            free = self.keys[at] == 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.children[at[put]] = key[left[put]] + np.uint64(1), child[left[put]]
            left = left[~put]
            slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Child nodes, 0 where there is none."""
        key = node.astype(np.uint64) << np.uint64(21) | code
        slot, out, want = self._slot(key), np.zeros(len(key), np.int32), key + np.uint64(1)
        look = np.arange(len(key))
        for _ in range(self.probes):
            there = self.keys[slot[look]]
            hit = there == want[look]
            out[look[hit]] = self.children[slot[look[hit]]]
            look = look[~hit & (there != 0)]
            if not len(look):
                break
            slot[look] = (slot[look] + 1) & (len(self.keys) - 1)
        return out

    def segment_many(self, words: list[str]) -> list[bytes]:
        """``_segment`` of many words at once; the same paths."""
        if not hasattr(self, "node_weight"):
            self._prepare_many()
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate(([0], np.cumsum(size)))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(code)
        end = np.repeat(first[1:], size)          # of the word, by character
        local = np.arange(n) - np.repeat(first[:-1], size)
        border = np.array(BORDER, np.int64)[local & 65535]
        # edges: start, length, weight
        at, node = np.arange(n), np.zeros(n, np.int32)
        starts, lengths, weights, pieces = [], [], [], []
        for length in range(1, self.longest + 1):
            node = self._next(node, code[at + length - 1])
            live = node > 0
            if length == 1:
                w = np.where(live, self.node_weight[node], FAR)
                w = np.where(w == FAR, self.unknown, w)  # a character without a piece
                starts.append(at), lengths.append(np.ones(n, np.int64)), weights.append(w), pieces.append(self.node_piece[node])
            else:
                w = self.node_weight[node]
                good = live & (w > FAR)
                starts.append(at[good]), lengths.append(np.full(good.sum(), length)), weights.append(w[good]), pieces.append(self.node_piece[node[good]])
            live &= at + length < end[at]
            at, node = at[live], node[live]
            if not len(at):
                break
        start, length, weight, piece = map(np.concatenate, (starts, lengths, weights, pieces))
        weight = weight + border[start]
        stop = start + length                      # border after the last character, in the flat text
        order = np.lexsort((start, stop, local[start] + length))
        start, stop, weight, piece = start[order], stop[order], weight[order], piece[order]
        step = local[start] + (stop - start)
        cut = np.searchsorted(step, np.arange(1, step[-1] + 2))
        # score and back at a border are kept at its last character
        score, back, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32)
        for a, b in zip(cut[:-1], cut[1:]):
            s, e = start[a:b], stop[a:b]
            total = weight[a:b] + np.where(local[s] > 0, score[s - 1], 0)
            group = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
            best = np.maximum.reduceat(total, group)
            # the first edge of each group that reaches the best
            hit = np.flatnonzero(total == np.repeat(best, np.diff(np.append(group, len(e)))))
            chosen = hit[np.searchsorted(hit, group)]
            score[e[chosen] - 1], back[e[chosen] - 1], last[e[chosen] - 1] = total[chosen], s[chosen], piece[a:b][chosen]
        # all words walk back together, one piece a round
        word, place, found = np.arange(len(words)), first[1:].copy(), []
        while len(word):
            found.append((word, last[place - 1]))
            place = back[place - 1]
            on = place > first[:-1][word]
            word, place = word[on], place[on]
        turn = np.repeat(np.arange(len(found)), [len(w) for w, _ in found])
        word, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-turn, word))
        word, ids = word[order], ids[order]
        edge = (np.searchsorted(word, np.arange(len(words) + 1)) * 4).tolist()
        flat = ids.astype(np.int32).tobytes()
        out = [flat[a:b] for a, b in zip(edge, edge[1:])]
        for i in np.unique(word[ids < 0]).tolist():  # characters without a piece become bytes
            out[i] = self._segment(words[i])
        return out

    # chunks --------------------------------------------------------------

    def _cuts(self, x: str, low: int, high: int, back: int) -> tuple[int, int] | None:
        """First word border at or after ``low`` and last one up to ``high``."""
        first = last = None
        for m in self.word.finditer(x):
            at = m.start()
            if at > high:
                break
            if at >= low and (at or not back):
                first, last = at if first is None else first, at
        return None if first is None else (first, last)

    def matrix(self, x: str, size: int, back: int) -> np.ndarray:
        """Entry state x exit state of a chunk of ``size`` characters followed,
        in x, by up to longest - 1 more; x starts ``back`` characters into a word."""
        n = self.longest
        out = np.full((n, n), NEVER, object)
        cuts = self._cuts(x, min(n - 1, size), size, back)
        if cuts:  # every path meets the cuts: what lies between them is the same for all
            first, last = cuts
            end = self.best(x[last:], 0, size - last, self.distances(x[last:]))[0] if last < size else [0]
            tail = [end[size - last + s] if size - last + s < len(end) else NEVER for s in range(n)]
            distance = self.distances(x[:first], back)
        else:
            distance = self.distances(x, back)
        for s_in in range(min(n, len(x) + 1)):
            if s_in >= size:  # a piece reaches over the whole chunk
                out[s_in, s_in - size] = 0
            elif cuts:
                head = self.best(x[:first], s_in, first, distance)[0][first]
                out[s_in] = [head + t for t in tail]
            else:
                score = self.best(x, s_in, size, distance)[0]
                for s in range(min(n, len(score) - size)):
                    out[s_in, s] = score[size + s]
        most = out.max()
        return np.array([FAR if e == NEVER else max(e - most, FAR) for e in out.ravel()], np.int64).reshape(n, n)

    def trace(self, x: str, size: int, s_in: int, s_out: int, back: int) -> bytes:
        """Piece ids of the best path from state ``s_in`` to state ``s_out``."""
        if s_in >= size:
            return b""
        end = size + s_out
        cuts = self._cuts(x, s_in, size, back)
        if not cuts:
            came = self.best(x[:end], s_in, size, self.distances(x[:end], back))[1]
            return self.ids_back(x[:end], came, s_in, end)
        first, last = cuts
        came = self.best(x[:first], s_in, first, self.distances(x[:first], back))[1]
        out = self.ids_back(x[:first], came, s_in, first) + self.encode(x[first:last])
        rest = x[last:end]
        came = self.best(rest, 0, size - last, self.distances(rest))[1]
        return out + self.ids_back(rest, came, 0, len(rest))

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_many(self, lists: pa.ListArray) -> list[str | None]:
        """The text of each list of ids (null: null)."""
        ids, null = lists.flatten(), lists.is_null().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(np.where(null, 0, np.diff(lists.offsets.to_numpy())))))
        laid = self.spelt.take(ids)   # their bytes stand in a row
        at = np.frombuffer(laid.buffers()[1], np.int64)[ends].tolist() if len(ids) else [0] * len(ends)
        data = memoryview(laid.buffers()[2] or b"")
        out = []
        for a, b, none in zip(at, at[1:], null.tolist()):
            raw = bytes(data[a:b])
            out.append(None if none else (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace"))
        return out


def write_out(text: str) -> str:
    """A text as the pieces write it, without the space in front."""
    return text.replace(SPACE, OWN_SPACE).replace(" ", SPACE)


def settled(m: np.ndarray) -> np.ndarray:
    """Scores up to a constant: the largest is 0, what no path reaches is FAR."""
    return np.where(m <= FAR // 2, FAR, m - m.max())


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices, up to a constant."""
    return settled((a[:, :, None] + b[None, :, :]).max(axis=1))


# Spark side --------------------------------------------------------------

_ID = "r1 long, r2 long"


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _parts(f: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes in one column."""
    if not f.num_rows:
        return
    a = f.column(column)
    if pa.types.is_list(a.type):
        size = np.cumsum(np.diff(a.offsets.to_numpy()).astype(np.int64) * 4)
    else:
        width = np.int64 if pa.types.is_large_string(a.type) else np.int32
        size = np.cumsum(np.diff(np.frombuffer(a.buffers()[1], width)[a.offset:a.offset + len(a) + 1]).astype(np.int64))
    at = 0
    while at < f.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield f.slice(at, end - at)
        at = end


def _encode_short(vocabulary):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value.prepare()
        for f in frames:
            for part in _parts(f, f.schema.get_field_index("text"), PART):
                ids = v.encode_many([SPACE + write_out(t) if t else "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sha"), part.column("n"), pa.array([1] * part.num_rows, pa.int64()), ids],
                                                 names=["doc_id", "text_sha256", "n_chars", "n_chunks", "ids"])
                pa.default_memory_pool().release_unused()  # else it grows with the parts, and stays with a reused worker
    return run


def _split(vocabulary, chunk: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary.value.prepare()
        for f in frames:
            for r in f.itertuples(index=False):
                written_text = SPACE + write_out(r.text)
                words = v.word.finditer(written_text)
                total, begin, word = -(-(r.n + 1) // chunk), 0, next(words)
                for a in range(0, total, 64):
                    rows = []
                    for c in range(a, min(total, a + 64)):
                        at = c * chunk
                        while word is not None and word.start() <= at:
                            begin, word = word.start(), next(words, None)
                        rows.append((r.r1, r.r2, c, min(chunk, r.n + 1 - at), at - begin, r.text[max(0, at - 1):at + chunk + v.longest - 2]))
                    yield pd.DataFrame(rows, columns=["r1", "r2", "c", "size", "back", "x"])
    return run


def _written_chunk(c: int, x: str) -> str:
    return (SPACE if c == 0 else "") + write_out(x)


def _matrices(vocabulary):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary.value.prepare()
        for f in frames:
            m = [v.matrix(_written_chunk(r.c, r.x), r.size, r.back).ravel() for r in f.itertuples(index=False)]
            yield f[["r1", "r2", "c"]].assign(m=m)
    return run


def _up(n: int):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in f.sort_values("c")["m"]:
            m = np.asarray(m, np.int64).reshape(n, n)
            out = m if out is None else product(out, m)
        return pd.DataFrame({"r1": [key[0]], "r2": [key[1]], "c": [key[2]], "m": [out.ravel()]})
    return run


def _down(n: int):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("c")
        ms = [np.asarray(m, np.int64).reshape(n, n) for m in f["m"]]
        to_end = np.full(n, FAR, np.int64)
        to_end[f["s_out"].iloc[0]] = 0
        after = [to_end]  # best score from each state to the exit of the group
        for m in reversed(ms[1:]):
            after.append(settled((m + after[-1]).max(axis=1)))
        states = [int(f["s_in"].iloc[0])]
        for m, rest in zip(ms, reversed(after)):
            states.append(int(np.argmax(m[states[-1]] + rest)))
        return pd.DataFrame({"r1": key[0], "r2": key[1], "c": f["c"], "s_in": states[:-1], "s_out": states[1:]})
    return run


def _traces(vocabulary):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary.value.prepare()
        for f in frames:
            ids = [np.frombuffer(v.trace(_written_chunk(r.c, r.x), r.size, r.s_in, r.s_out, r.back), np.int32) for r in f.itertuples(index=False)]
            yield f[["r1", "r2", "c"]].assign(ids=ids)
    return run


def border_states(matrices: DataFrame, states: int, fan_in: int = FAN_IN) -> DataFrame:
    """(r1, r2, c, s_in, s_out) of every chunk from its transfer matrices."""
    levels = [matrices]
    most = matrices.agg(F.max("c")).first()[0] or 0
    parent = F.floor(F.col("c") / fan_in).cast("long")
    while most:
        up = levels[-1].groupBy("r1", "r2", parent.alias("c")).applyInPandas(_up(states), f"{_ID}, c long, m array<long>")
        levels.append(written(up, "pieces-level"))
        most //= fan_in
    known = levels[-1].select("r1", "r2", "c", F.lit(0).alias("s_in"), F.lit(0).alias("s_out"))
    for level in reversed(levels[:-1]):
        inside = level.withColumn("p", parent).join(known.withColumnRenamed("c", "p"), ["r1", "r2", "p"])
        known = inside.groupBy("r1", "r2", "p").applyInPandas(_down(states), f"{_ID}, c long, s_in int, s_out int")
    return known


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: Vocabulary | None = None,
           chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, text_sha256, n_chars, n_chunks long, ids array<int> for every row."""
    spark: SparkSession = shipped(docs.sparkSession)
    v = vocabulary or Vocabulary.load(default_model())
    longest = v.prepare().longest
    if chunk < 1:
        raise ValueError("chunk must be positive")
    shared = spark.sparkContext.broadcast(Vocabulary(v.pieces))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"), F.char_length(t).cast("long").alias("n"))
    kind = dict(given.dtypes)["doc_id"]
    short = (given.where(F.col("n") < chunk).select("doc_id", "text", "n", F.sha2("text", 256).alias("sha"))
             .mapInArrow(_encode_short(shared), f"doc_id {kind}, text_sha256 string, n_chars long, n_chunks long, ids array<int>"))

    key = dict(zip(("r1", "r2"), row_key(F.col("doc_id"), F.col("text"))))
    long_docs = given.where(F.col("n") >= chunk).withColumns(key)
    named = written(long_docs.groupBy("r1", "r2").agg(F.first("doc_id").alias("doc_id"), F.first(F.sha2("text", 256)).alias("text_sha256"), F.first("n").alias("n_chars"), F.count(F.lit(1)).alias("copies")), "pieces-long")
    chunks = long_docs.select("r1", "r2", "n", "text").mapInPandas(_split(shared, chunk), f"{_ID}, c long, size long, back long, x string")
    # repeated rows have the same chunks: one of each, dealt out by chunk
    chunks = written(chunks.groupBy("r1", "r2", "c").agg(*[F.first(x).alias(x) for x in ("size", "back", "x")]), "pieces-chunks")
    matrices = written(chunks.repartition("r1", "c").mapInPandas(_matrices(shared), f"{_ID}, c long, m array<long>"), "pieces-matrices")
    states = written(border_states(matrices, longest, fan_in), "pieces-states")
    ids = chunks.join(states, ["r1", "r2", "c"]).mapInPandas(_traces(shared), f"{_ID}, c long, ids array<int>")
    whole = (ids.groupBy("r1", "r2").agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("x"))
             .select("r1", "r2", F.flatten(F.transform("x", lambda e: e["ids"])).alias("ids"), F.size("x").cast("long").alias("n_chunks")))
    long = (named.join(whole, ["r1", "r2"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "text_sha256", "n_chars", "n_chunks", "ids"))
    return short.unionByName(long)


def _decode(vocabulary, at: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value.prepare_decoding()
        for f in frames:
            for part in _parts(f, at, PART):
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns) if i != at] + [pa.array(v.decode_many(part.column(at)), pa.string())],
                                                 names=[n for i, n in enumerate(f.schema.names) if i != at] + ["decoded"])
    return run


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """``encoded`` with the column ``decoded`` in place of the ids; null ids give null."""
    v = vocabulary or Vocabulary.load(default_model())
    shared = shipped(encoded.sparkSession).sparkContext.broadcast(Vocabulary(v.pieces))
    rest = encoded.select(*[c for c in encoded.columns if c.lower() != "decoded"])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields if f.name != ids] + ["decoded string"])
    return rest.mapInArrow(_decode(shared, rest.columns.index(ids)), schema)
