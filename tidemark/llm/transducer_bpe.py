"""BPE encoding and decoding with a minimal acyclic transducer for the frequent words.

``frequent_words`` counts pieces over all documents with a mergeable heavy-hitter summary;
``build_transducer`` turns the most frequent ones into the smallest acyclic automaton that
shares prefixes and suffixes. Its arcs carry numbers whose sum along a path is the word's
rank in sorted order, and the rank selects the word's id output. The automaton is one file of
plain arrays in the shared folder, which workers memory-map. Words that it lacks are merged
exactly by the ranks of the tokenizer's merge list, short ones many at a time, long ones through a heap. The lexicon only decides
which way a word takes; both ways give the same ids.

Defined cases: null text is empty, empty text has no ids; special-token strings in a text
become their ids, as the library has it; repeated rows each get a row; an empty table gives an
empty automaton and no rows; further columns go. Memory is bounded: the memo of stretches is trimmed at a fixed number and length.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import materialize, new_folder, open_fs
from tidemark.llm.token_files import ChunkMemo, gather
from tidemark.llm.wordsplit import byte_letters, chunks_of, pieces, split_specials

LEXICON_WORDS = 100_000
SUMMARY_WORDS = 60_000
_MEMO = (400_000, 200_000)
_CODERS: dict[tuple[str, str], "Coder"] = {}
_NONE = np.iinfo(np.int32).max
_PLACE = (1 << 40) - 1
LONG_WORD = 128
_LONG_CHUNK, _LEXICON_BYTES = 256, 64


# --- the tokenizer file ------------------------------------------------------------------


class Merges:
    """Exact BPE of the tokenizer file: vocabulary, merge ranks, many words at a time."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        keys = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pairs: dict[int, tuple[int, int]] = {}
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), np.array([c for *_, c in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (UTF-8). Words of similar length are merged together, in chunks of bounded size."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        for i in (i for i, w in enumerate(words) if len(w) > LONG_WORD):
            out[i] = self.encode_long(words[i])
        order = sorted((i for i, w in enumerate(words) if len(w) <= LONG_WORD), key=lambda i: len(words[i]))
        a = 0
        while a < len(order):
            b = a + 1
            width = len(words[order[a]])
            while b < len(order) and len(words[order[b]]) <= width + 2 and (b - a) * len(words[order[b]]) < 1 << 20:
                b += 1
            self._chunk([words[i] for i in order[a:b]], order[a:b], out)
            a = b
        return out

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same merges in ``n log n`` steps: tokens in a linked list, pairs in a heap by rank, then place."""
        if not self.pairs:
            self.pairs.update(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made[self.ranks].tolist())))
        raw = np.frombuffer(word, np.uint8)
        start = self.inner[raw]
        start[-1] = self.last[raw[-1]]
        rank = self.rank(start[:-1], start[1:]).astype(np.int64)
        at = np.flatnonzero(rank < _NONE)
        heap = (rank[at] << 40 | at).tolist()
        heapify(heap)
        ids, n, known = start.tolist(), len(start), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & _PLACE
            j = after[i]
            if ids[i] < 0 or j == n:
                continue
            found = known(ids[i] << 32 | ids[j])
            if found is None or found[0] != entry >> 40:
                continue  # one of the two has merged since
            ids[i], ids[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if new := known(ids[i] << 32 | ids[k]):
                    heappush(heap, new[0] << 40 | i)
            h = before[i]
            if h >= 0 and (new := known(ids[h] << 32 | ids[i])):
                heappush(heap, new[0] << 40 | h)
        flat = np.array(ids, np.int64)
        return flat[flat >= 0]

    def _chunk(self, words: list[bytes], places: list[int], out: list) -> None:
        size = np.array([len(w) for w in words])
        n, width = len(words), int(size.max(initial=0))
        if not width:
            return
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = self.inner[raw]
        ids[np.arange(n)[size > 0], size[size > 0] - 1] = self.last[raw[np.arange(n)[size > 0], size[size > 0] - 1]]
        ids[np.arange(width) >= size[:, None]] = -1
        pad = np.full((n, 1), -1, np.int64)
        ids = np.hstack([ids, pad])
        rank = np.full((n, width), _NONE, np.int32)
        there = ids[:, 1:] >= 0
        rank[there] = self.rank(ids[:, :-1][there], ids[:, 1:][there])
        live = np.arange(n)
        while True:
            best = rank.argmin(axis=1)
            found = rank[np.arange(len(rank)), best] < _NONE
            for i in np.flatnonzero(~found):
                row = ids[i]
                out[places[live[i]]] = row[row >= 0].copy()
            if not found.any():
                return
            live, ids, rank, best = live[found], ids[found], rank[found], best[found]
            rows = np.arange(len(live))
            merged = self.made[rank[rows, best]]
            cols = np.arange(ids.shape[1] - 1)
            gone = cols[None, :] > best[:, None]
            ids[:, :-1] = np.where(gone, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[rows, best] = merged
            cols = np.arange(rank.shape[1] - 1)
            rank[:, :-1] = np.where(cols[None, :] > best[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            for at in (best - 1, best):
                ok = (at >= 0) & (at < rank.shape[1])
                r, c = rows[ok], at[ok]
                left, right = ids[r, c], ids[r, c + 1]
                rank[r, c] = np.where(right >= 0, self.rank(left, np.maximum(right, 0)), _NONE)


# --- the automaton -----------------------------------------------------------------------


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted, distinct words, with word numbers on its arcs.

    Words are added in order; a state whose words are complete is replaced by an equal one if there
    is one (Daciuk and others, 2000). ``arc_key`` is ``state * 256 + byte``, sorted; ``arc_add`` is how
    many words of the state sort before those of the arc.
    """
    register: dict[tuple, int] = {}
    done: list[tuple[bool, tuple]] = []
    count: list[int] = []

    def close(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        state = register.get(key)
        if state is None:
            state = register[key] = len(done)
            done.append(key)
            count.append(final + sum(count[t] for _, t in arcs))
        return state

    path: list[list] = [[False, []]]  # open states along the last word: final, arcs
    last = b""
    for word in words:
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        for depth in range(len(last), same, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[depth - 1], close(final, arcs)))
        path.extend([False, []] for _ in range(len(word) - same))
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        final, arcs = path.pop()
        path[-1][1].append((last[depth - 1], close(final, arcs)))
    root = close(*path[0])
    rows = []
    for state, (final, arcs) in enumerate(done):
        add = int(final)
        for byte, target in arcs:
            rows.append((state << 8 | byte, target, add))
            add += count[target]
    table = np.array(rows, np.int64).reshape(-1, 3)
    table = table[np.argsort(table[:, 0], kind="stable")]
    return {"root": np.array([root]), "final": np.array([f for f, _ in done], np.int64), "arc_key": table[:, 0].copy(), "arc_to": table[:, 1].copy(), "arc_add": table[:, 2].copy()}


class Transducer:
    """Reads the arrays of ``build_transducer`` from a mapped file and looks words up, many at a time."""

    FIELDS = ("root", "final", "arc_key", "arc_to", "arc_add", "out_start", "out_ids")

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else pa.BufferReader(fs.open_input_file(path).read_buffer())
        buf = np.frombuffer(self.source.read_buffer(), np.int64)
        at = len(self.FIELDS)
        for name, n in zip(self.FIELDS, buf[:at].tolist()):
            setattr(self, name, buf[at : at + n])
            at += n

    @classmethod
    def dump(cls, arrays: dict[str, np.ndarray]) -> bytes:
        parts = [np.asarray(arrays[f], np.int64) for f in cls.FIELDS]
        return np.concatenate([np.array([len(p) for p in parts], np.int64), *parts]).tobytes()

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1."""
        size = np.array([len(w) for w in words], np.int64)
        state = np.full(len(words), int(self.root[0]))
        number = np.zeros(len(words), np.int64)
        if not len(self.arc_key):
            return np.full(len(words), -1)
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        alive = order
        longest = int(size.max(initial=0))
        for depth in range(longest):
            alive = alive[(size[alive] > depth) & (state[alive] >= 0)]
            if not len(alive):
                break
            key = state[alive] << 8 | flat[start[alive] + depth]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            ok = self.arc_key[arc] == key
            state[alive] = np.where(ok, self.arc_to[arc], -1)
            number[alive] += np.where(ok, self.arc_add[arc], 0)
        ends = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(ends, number, -1)


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS, summary: int = SUMMARY_WORDS) -> list[str]:
    """The most frequent pieces, by a summary over all documents.

    Each task counts stretches between white space; when they exceed four times ``summary``, all counters fall by
    the one that leaves ``summary`` (Misra and Gries), so no stretch with more than its share is lost. Their pieces
    are summed over the tasks.
    The driver receives ``limit`` words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for k, part in enumerate(split_specials(text.as_py() or "")):
                    if not k % 2:
                        for chunk in chunks_of(part):
                            if len(chunk) <= _LONG_CHUNK:
                                seen[chunk] += 1
                            else:  # its pieces are stretches too; those too long for the lexicon would only fill memory
                                seen.update(p for p in pieces(chunk) if len(p) <= _LEXICON_BYTES)
                if len(seen) > 4 * summary:
                    seen = shrink(seen)
        if len(seen) > summary:
            seen = shrink(seen)
        words: Counter = Counter()
        for chunk, n in seen.items():
            for word in pieces(chunk):
                words[word] += n
        if words:
            yield pa.RecordBatch.from_pydict({"word": list(words), "n": pa.array(list(words.values()), pa.int64())})

    def shrink(seen: Counter) -> Counter:
        values = np.fromiter(seen.values(), np.int64, len(seen))
        cut = int(np.partition(values, len(values) - summary)[len(values) - summary])
        return Counter({w: c - cut for w, c in seen.items() if c > cut})

    counted = docs.select("text").mapInArrow(count, "word string, n long")
    words = materialize(counted.where(F.octet_length("word") <= _LEXICON_BYTES).groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    # A histogram over powers of two finds a count that few words reach, so the sort sees a bounded number of them.
    steps = sorted(((r.k, r.m) for r in words.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("m")).collect()), reverse=True)
    least, seen = 1 << 62, 0
    for k, m in steps:
        seen += m
        if seen > 4 * limit and least < 1 << 62:
            break
        least = 1 << k
    top = words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(limit)
    return [r.word for r in top.select("word").collect()]


def build_transducer(words: list[str], tokenizer: str, folder: str) -> str:
    """Compile words and their ids into one file below ``folder``; returns its URI."""
    raw = sorted({w.encode() for w in words})
    outputs = Merges(tokenizer).encode(raw)
    arrays = minimal_automaton(raw)
    arrays["out_start"] = np.cumsum([0, *map(len, outputs)])
    arrays["out_ids"] = np.concatenate([np.zeros(0, np.int64), *outputs])
    uri = f"{folder}/words.transducer"
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(Transducer.dump(arrays))
    return uri


# --- coding ------------------------------------------------------------------------------


class Coder:
    """Encodes and decodes whole texts; stretches between white space are remembered up to a bound."""

    def __init__(self, tokenizer: str, lexicon: str):
        self.merges, self.lexicon = Merges(tokenizer), Transducer(lexicon)
        self.token = [self.merges.tokens.get(i, "") for i in range(max(self.merges.tokens) + 1)]
        self.memo = ChunkMemo(np.uint32)

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words: from the automaton, or merged exactly."""
        number = self.lexicon.find(words)
        known, rest = np.flatnonzero(number >= 0), np.flatnonzero(number < 0).tolist()
        ids: list = [None] * len(words)
        for i, a, b in zip(known.tolist(), self.lexicon.out_start[number[known]].tolist(), self.lexicon.out_start[number[known] + 1].tolist()):
            ids[i] = self.lexicon.out_ids[a:b]
        for i, got in zip(rest, self.merges.encode([words[i] for i in rest])):
            ids[i] = got
        return ids

    def learn(self) -> None:
        """Settle the memo's new stretches."""
        split = [pieces(c) for c in self.memo.new]
        place: dict[str, int] = {}
        for p in split:
            for w in p:
                place.setdefault(w, len(place))
        ids = self.words([w.encode() for w in place])
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *ids])
        of = np.array([place[w] for p in split for w in p], np.int64)
        owner = np.repeat(np.arange(len(split)), [len(p) for p in split])
        starts = np.cumsum(size) - size
        sizes = np.bincount(owner, size[of], len(split)).astype(np.int64)
        self.memo.settle(gather(flat, starts[of], size[of]), sizes)

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        self.memo.trim(*_MEMO)
        split = [[self.memo.places(p) if not k % 2 else p for k, p in enumerate(split_specials(t))] for t in texts]
        if self.memo.new:
            self.learn()
        for parts in split:
            out = [np.array([self.merges.specials[p]], np.uint32) if k % 2 else self.memo.ids(p) for k, p in enumerate(parts)]
            yield out[0] if len(out) == 1 else np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by blanks: what the library gives for a file without a decoder, special tokens kept."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


def coder(tokenizer: str, lexicon: str) -> Coder:
    key = (tokenizer, lexicon)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(tokenizer, lexicon)
    return _CODERS[key]


def small_groups(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, null as empty, about ``most`` characters at a time; with the place of the first."""
    group, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        group.append(t)
        size += len(t)
        if size >= most:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def encode_documents(docs: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """``doc_id``, the ids and the decoded text of every document; further columns go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer, lexicon)
        for batch in batches:
            for first, texts in small_groups(batch.column(1)):
                ids = list(code.encode_batch(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([code.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<long>, decoded string")


def encode_digest(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """Lexicon from all documents, then per document ``n_tokens`` and the hashes of its ids and of its decoded text; ``with_ids`` the ids too."""
    lexicon = build_transducer(frequent_words(docs, words), tokenizer, new_folder(docs.sparkSession, "lexicon"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer, lexicon)
        for batch in batches:
            for first, texts in small_groups(batch.column(1)):
                kept, n, a, b = [], [], [], []
                for ids in code.encode_batch(texts):
                    kept += [ids.astype(np.int32)] if with_ids else []
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(code.decode(ids).encode()).hexdigest())
                columns = {"doc_id": batch.column(0).slice(first, len(texts)), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *kept])))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
