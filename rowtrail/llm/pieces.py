"""SentencePiece encoding and decoding over a relational lattice of the corpus's distinct words.

1. Each block of rows lists its distinct words.  A word is a run of spaces with what follows up to the next space, line
   break, or change between punctuation and other characters, as far as no piece of the model crosses such a border.
2. Each distinct word of the corpus explodes into its substrings of bounded length; an equi-join with the piece table
   (of the model's fixed size, broadcast) leaves the lattice's edges, which are grouped by word.
3. A fold turns a word's edges into its segmentation.  For a unigram model that is Viterbi with Spark's ``aggregate``.
   A BPE model does not define the best-scored path: it merges the best-ranked adjacent pair again and again, so
   there the fold does that over the same edges, for all words of an Arrow batch in step.  The state is a bit mask of the borders that still stand.
4. The segmentations go back to the blocks that have the words, and every text is put together from them.

Texts are scanned twice and never shuffled.
"""

from __future__ import annotations

import heapq
import re
import string
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SideTable, buffers, by_block, placed, scanned, slices, small_batches, written

SPACE = "▁"
#: Words of up to so many characters are folded in Spark (the mask has 64 bits); longer ones are merged in the task.
FOLD_CHARS = 60
#: Words asked for singly whose ids a task keeps at hand, and masks whose borders it does.
KEPT_WORDS, KEPT_MASKS = 1 << 12, 1 << 14
#: Of so many words of a block, the first is kept in a list by which a single word is found.
ROW_WORDS = 16
#: Words of a block whose masks are turned into ids at a time.
MASKS_AT_ONCE = 1 << 14
#: Bytes of text whose ids are put together at a time; each time a block's words are hashed anew.
ASSEMBLED_BYTES = 1 << 20
#: Distinct words of single slices that a task lets pile up before it throws out those that several slices have.
PILED_WORDS = 1 << 16
#: What a byte is to the borders of words.
OTHER, MARK, BLANK, BREAK = range(4)


#: Where the public 32k model lies unless another path is given; the driver alone reads it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Pieces:
    """The vocabulary: pieces, scores, byte pieces, and how its words are to be segmented."""

    def __init__(self, texts: list[str], scores: list[float], kind: str, byte_first: int | None, unknown: int = 0, plain: list[bool] | None = None):
        self.texts, self.scores, self.kind, self.byte_first, self.unknown = texts, scores, kind, byte_first, unknown
        self.plain = plain or [True] * len(texts)
        self.longest = max((len(t) for t, p in zip(texts, self.plain) if p), default=1)
        self.marks, self.odd = self._borders()
        if any(SPACE in t.lstrip(SPACE) or "\n" in t for t, p in zip(texts, self.plain) if p):
            raise ValueError("pieces that cross a word's border are not supported")

    def _borders(self) -> tuple[str, str]:
        """(marks, odd): punctuation that no piece joins to a letter or digit, so a word may be cut around it; and the
        characters that some piece does join to it, whose texts are not cut there."""
        joined: dict[str, set[str]] = {c: set() for c in string.punctuation}
        for t, plain in zip(self.texts, self.plain):
            if plain:
                for a, b in zip(t, t[1:]):
                    if a in joined:
                        joined[a].add(b)
                    if b in joined and a != SPACE:
                        joined[b].add(a)
        marks = {c for c, near in joined.items() if not any(x.isascii() and x.isalnum() for x in near)}
        return "".join(sorted(marks)), "".join(sorted({x for c in marks for x in joined[c]} - marks))

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of texts, one after the other, and where each text's begin among them (and the last one's end).

        A text gets a leading dummy space; the model takes its space mark for a space.  Nulls count as empty.
        """
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        raw, off = buffers(texts)
        kinds = np.zeros(256, np.uint8)
        kinds[[*self.marks.encode()]], kinds[32], kinds[10] = MARK, BLANK, BREAK
        kind = np.frombuffer(bytearray(raw.tobytes().translate(kinds.tobytes())), np.uint8)
        if self.odd and self.marks:
            odd = pc.match_substring_regex(texts, f"[{re.escape(self.odd)}]").to_numpy(zero_copy_only=False)
            if odd.any():
                kind[np.repeat(odd, np.diff(off)) & (kind == MARK)] = OTHER
        first = np.ones(len(raw), bool)
        first[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK) | (kind[1:] == BREAK)
        first[off[off < len(raw)]] = True
        starts = np.flatnonzero(first)
        return cut_at(raw, starts), np.searchsorted(starts, off)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "\ufb01 \u2460\uff21  x\u00e9e\u0301 "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("models that normalise texts, or add no leading space, are not supported")
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        first = next((i for i in range(n) if sp.is_byte(i)), None)
        scores = [sp.get_score(i) for i in range(n)]
        # a BPE model scores its merges by their order, in whole numbers; a unigram model has log-probabilities
        kind = "bpe" if all(s == int(s) for s, p in zip(scores, plain) if p) else "unigram"
        return cls(texts, scores, kind, first, sp.unk_id(), plain)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, score) of the pieces that texts are made of."""
        rows = [(t, float(s)) for t, s, p in zip(self.texts, self.scores, self.plain) if p]
        return spark.createDataFrame(rows, "piece string, score double")

    def ids(self) -> dict[str, int]:
        return {t: i for i, (t, p) in enumerate(zip(self.texts, self.plain)) if p}


def cut_at(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    """UTF-8 bytes as the strings that begin at the given places; the first begins at 0, each ends where the next begins."""
    bounds = np.append(starts, len(raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))


# ---------------------------------------------------------------- the lattice


def border(k: Column) -> Column:
    """The mask with bit k alone."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _fold_bpe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (word, mask) from (word, n, packed edges), all words of a batch in step.

    An edge is two adjacent symbols if both its borders stand and one between them does; each round merges every
    word's first such edge by rank and start, and forgets edges that have lost a border.
    """
    one = np.uint64(1)
    for batch in batches:
        lists = batch.column("packed")
        v = np.asarray(lists.flatten())
        n = np.asarray(batch.column("n")).astype(np.uint64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        order = np.lexsort((v, owner))
        v, owner = v[order], owner[order]
        start, stop = ((v >> 7) & 127).astype(np.uint64), (v & 127).astype(np.uint64)
        ends, inner = (one << start) | (one << stop), (one << stop) - (one << (start + one))
        mask = (one << (n + one)) - one
        while len(v):
            now = mask[owner]
            stands = (now & ends) == ends
            owner, ends, inner, now, v = owner[stands], ends[stands], inner[stands], now[stands], v[stands]
            free = np.flatnonzero(np.bitwise_count(now & inner) == 1)
            if not len(free):
                break
            first = free[np.append(True, owner[free][1:] != owner[free][:-1])]
            mask[owner[first]] &= ~inner[first]
        yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(mask.view(np.int64))], names=["word", "mask"])


def fold_viterbi(edges: Column, n: Column, unknown: float) -> Column:
    """Border mask of the best-scored path.  Edges: (start, stop, score) in any order.

    The state has, for each position, the best score and mask of a path that ends there; a position that no edge
    reaches takes the character before it at the score ``unknown``.  Ties go to the longer last piece.
    """

    def step(best: Column, k: Column) -> Column:
        into = F.filter(edges, lambda e: e["stop"] == k)
        bit = border(k)
        paths = F.transform(into, lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("start"), F.get(best, e["start"])["mask"].bitwiseOR(bit).alias("mask")))
        alone = F.struct((F.get(best, k - 1)["score"] + F.lit(unknown)).alias("score"), (-(k - 1)).alias("start"), F.get(best, k - 1)["mask"].bitwiseOR(bit).alias("mask"))
        singles = F.exists(into, lambda e: e["start"] == k - 1)
        top = F.array_max(F.when(singles, paths).otherwise(F.concat(paths, F.array(alone))))
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), top["mask"].alias("mask"))))

    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("mask")))
    return F.get(F.aggregate(F.sequence(F.lit(1), n), zero, step), n)["mask"]


def segment_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, mask) of distinct words (with ``SPACE`` for spaces): bit i of the mask is set where a piece borders character i.

    The words must be dealt out by word already: exploding and the broadcast join keep that, so grouping needs no shuffle.
    """
    spark = words.sparkSession
    n = F.length("word")
    least = 2 if pieces.kind == "bpe" else 1
    starts = words.where(n >= least).select("word", n.alias("n"), F.explode(F.sequence(F.lit(0), n - least)).alias("start"))
    spans = starts.select("word", "n", "start", F.explode(F.sequence(F.col("start") + least, F.least(F.col("n"), F.col("start") + pieces.longest))).alias("stop"))
    piece = F.col("word").substr(F.col("start") + 1, F.col("stop") - F.col("start"))
    subs = spans.select("word", "n", "start", "stop", piece.alias("span")).withColumn("key", F.xxhash64("span"))
    # a join on whole numbers with the text as a condition: the hash table of whole numbers is the fast one
    table = F.broadcast(pieces.table(spark).withColumn("key", F.xxhash64("piece")))
    edges = subs.join(table, (subs["key"] == table["key"]) & (F.col("span") == F.col("piece")))
    if pieces.kind == "bpe":
        # rank, start and stop in one whole number, so edges are gathered and sorted as such
        packed = (-F.col("score")).cast("long") * 16384 + F.col("start") * 128 + F.col("stop")
        return edges.groupBy("word", "n").agg(F.collect_list(packed).alias("packed")).mapInArrow(_fold_bpe, "word string, mask long")
    grouped = edges.groupBy("word", "n").agg(F.collect_list(F.struct("start", "stop", "score")).alias("edges"))
    lowest = min((s for s, p in zip(pieces.scores, pieces.plain) if p), default=0.0)
    return grouped.select("word", fold_viterbi(F.col("edges"), F.col("n"), lowest - 10.0).alias("mask"))


# ---------------------------------------------------------------- in the tasks


def merge_long(word: str, ranks: dict[str, float]) -> list[str]:
    """The pieces of one long word by BPE with a heap over adjacent pairs: the same merges as the fold's."""
    n = len(word)
    size = [1] * n
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j >= 0 and (score := ranks.get(word[i : j + size[j]])) is not None:
            heapq.heappush(heap, (-score, i, size[i], size[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if size[i] else -1
        if j < 0 or size[i] != a or size[j] != b:
            continue
        size[i], size[j] = a + b, 0
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [word[i : i + s] for i, s in enumerate(size) if s]


def best_path(word: str, scores: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The pieces of one long word by Viterbi, as the fold has it."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for k in range(1, len(word) + 1):
        paths = [(best[s][0] + scores[word[s:k]], -s) for s in range(max(0, k - longest), k) if word[s:k] in scores]
        if word[k - 1 : k] not in scores:
            paths.append((best[k - 1][0] + unknown, 1 - k))
        top = max(paths)
        best.append((top[0], -top[1]))
    out, k = [], len(word)
    while k:
        out.append(word[best[k][1] : k])
        k = best[k][1]
    return out[::-1]


class Encoder:
    """Puts texts together from segmented words."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.ids = pieces, pieces.ids()
        self.scores = {t: s for t, s, p in zip(pieces.texts, pieces.scores, pieces.plain) if p}
        self.cuts: dict[int, list[tuple[int, int]]] = {}  # the pieces' borders of a mask
        self.back = [t.replace(SPACE, " ") if p else "" for t, p in zip(pieces.texts, pieces.plain)]
        if pieces.byte_first is not None:
            self.back[pieces.byte_first : pieces.byte_first + 256] = [chr(b) if b < 128 else chr(0xDC00 + b) for b in range(256)]
        self.back_bytes = pa.array([t.encode("utf-8", "surrogateescape") for t in self.back], pa.binary())
        self.held, self.numbers = pa.array(list(self.ids), pa.string()), np.array(list(self.ids.values()), np.int32)

    def of_segments(self, segments: list[str]) -> tuple[int, ...]:
        """Piece ids; a character that is no piece becomes its bytes, or the unknown piece where there are none."""
        out: list[int] = []
        for s in segments:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.pieces.byte_first is not None:
                out += [self.pieces.byte_first + b for b in s.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.pieces.unknown)
        return tuple(out)

    def of_word(self, word: str, mask: int | None) -> tuple[int, ...]:
        """Ids of a word: by its mask, or, where it is too long for one, by the same rule here."""
        w = word.replace(" ", SPACE)
        if len(w) > FOLD_CHARS:
            if self.pieces.kind == "bpe":
                return self.of_segments(merge_long(w, self.scores))
            lowest = min(self.scores.values(), default=0.0)
            return self.of_segments(best_path(w, self.scores, self.pieces.longest, lowest - 10.0))
        if mask is None:
            return self.of_segments(list(w))
        pairs = self.cuts.get(mask)
        if pairs is None:
            cuts = [i for i in range(64) if mask >> i & 1]
            if len(self.cuts) >= KEPT_MASKS:
                self.cuts.clear()
            pairs = self.cuts[mask] = list(zip(cuts, cuts[1:]))
        segments = [w[a:b] for a, b in pairs]
        try:
            return tuple(map(self.ids.__getitem__, segments))
        except KeyError:
            return self.of_segments(segments)

    def of_words(self, words: pa.Array, masks: np.ndarray) -> pa.Array:
        """Ids of many words (with ``SPACE`` for spaces) by their masks, packed as 32-bit numbers: ``of_word`` for all of
        them in step.  The pieces lie end to end in the words' bytes, so their borders alone make them."""
        raw, off = buffers(words)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        at = np.searchsorted(heads, off)
        word, k = np.nonzero(np.unpackbits(masks.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        inside = k < np.diff(at)[word]  # the border at a word's end is where the next one begins
        word, starts = word[inside], heads[at[word[inside]] + k[inside]]
        place = pc.index_in(cut_at(raw, starts), value_set=self.held)
        ids = self.numbers[place.fill_null(0).to_numpy()]
        bounds = np.searchsorted(word, np.arange(len(words) + 1))
        if place.null_count:
            lost = place.is_null().to_numpy(zero_copy_only=False)
            ids[lost] = self.pieces.unknown
            if self.pieces.byte_first is not None:
                size = np.diff(np.append(starts, len(raw)))
                many = np.where(lost, size, 1)
                ids = np.repeat(ids, many)
                ids[np.repeat(lost, many)] = self.pieces.byte_first + raw[np.repeat(lost, size)].astype(np.int32)
                bounds = np.append(0, np.cumsum(many))[bounds]
        return packed_ids(ids, bounds)

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """``decode`` for many texts, whose ids lie end to end between the bounds."""
        spans = self.back_bytes.take(pa.array(ids))
        if not len(spans):
            return pa.array([""] * (len(bounds) - 1), pa.string())
        _, off, data = spans.buffers()
        ends = np.frombuffer(off, np.int32)[bounds]
        try:
            texts = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), data]).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:])], pa.string())
        return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the leading dummy space; bytes that are no UTF-8 become replacement characters."""
        text = "".join(map(self.back.__getitem__, ids))
        if not text.isascii() and re.search("[\udc80-\udcff]", text):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def packed_ids(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Ids end to end as one binary value for each stretch between the bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids)])


def _vocabulary(pieces):
    """Task: the distinct words of each block that are short enough to be folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _split_words(batches, pieces.value)

    return run


def _split_words(batches: Iterator[pa.RecordBatch], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    seen: list[pa.Array] = []
    at_block = None

    def settle() -> pa.Array:
        seen[:] = [pc.unique(pa.concat_arrays(seen))] if seen else [pa.array([], pa.string())]
        pa.default_memory_pool().release_unused()
        return seen[0]

    def out() -> Iterator[pa.RecordBatch]:
        words = pc.replace_substring(settle(), " ", SPACE)
        seen.clear()
        words = words.take(pc.array_sort_indices(words))  # neighbours pack well
        for i in range(0, len(words), 20_000):
            part = words.slice(i, 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), at_block, np.int64)), part], names=["block", "word"])

    for batch in batches:
        for same in by_block(batch):
            if (block := same.column("block")[0].as_py()) != at_block:
                yield from out()
                at_block = block
            for part, _, _ in slices(same, "text"):
                words = pc.unique(pieces.words(part.column("text"))[0])
                size = pc.utf8_length(words)
                seen.append(words.filter(pc.and_(pc.greater(size, 1), pc.less_equal(size, FOLD_CHARS))))
                if sum(map(len, seen[1:])) > max(PILED_WORDS, len(seen[0]) // 2):
                    settle()
    yield from out()


class _Words(dict):
    """Ids of a block's words, packed as 32-bit numbers.

    The block's folded words lie in Arrow arrays, with the ids that their masks give, and the words of many texts are
    looked up in step.  Other words (single characters, words without edges, long ones) are made when first asked for,
    as is any word that is asked for singly; of these, twice ``KEPT_WORDS`` are kept at most.
    """

    def __init__(self, encoder: Encoder, side: SideTable):
        super().__init__()
        self.encoder, self.side, self.block = encoder, side, None
        self._empty()

    def _empty(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.masks, self.older = np.zeros(0, np.int64), {}
        self.firsts: list[str] | None = None
        self.clear()

    def open(self, block: int) -> None:
        if block == self.block:
            return
        self._empty()
        self.block = block
        table = self.side.load(block)
        if table is None:
            return
        if not pc.all(pc.less_equal(table.column("word").slice(0, table.num_rows - 1), table.column("word").slice(1))).as_py():
            table = table.sort_by("word")
        words, ids = [], []
        for part in table.to_batches(max_chunksize=MASKS_AT_ONCE):
            ids.append(self.encoder.of_words(part.column("word"), part.column("mask").to_numpy()))
            words.append(pc.replace_substring(part.column("word"), SPACE, " "))
        self.words, self.ids, self.masks = pa.concat_arrays(words), pa.concat_arrays(ids), table.column("mask").to_numpy()
        del table, words, ids
        pa.default_memory_pool().release_unused()

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts of the block, end to end, and where each text's begin (and the last one's end)."""
        words, at = self.encoder.pieces.words(texts)
        place, ids = pc.index_in(words, value_set=self.words), self.ids
        if place.null_count:
            others = words.filter(place.is_null()).dictionary_encode()
            ids = pa.concat_arrays([ids, pa.array([self[w] for w in others.dictionary.to_pylist()], pa.binary())])
            place = pc.replace_with_mask(place, place.is_null(), pc.add(others.indices, pa.scalar(len(self.words), pa.int32())))
        _, off, data = ids.take(place).buffers()
        ends = np.frombuffer(off, np.int32)[: len(place) + 1] // 4
        return np.frombuffer(data, np.int32)[: ends[-1]] if ends[-1] else np.zeros(0, np.int32), ends[at]

    def mask(self, word: str) -> int | None:
        if self.firsts is None:
            self.firsts = pc.replace_substring(self.words.take(pa.array(range(0, len(self.words), ROW_WORDS), pa.int32())), " ", SPACE).to_pylist()
        i = ROW_WORDS * (bisect_right(self.firsts, word.replace(" ", SPACE)) - 1)
        row = self.words.slice(i, ROW_WORDS).to_pylist() if i >= 0 else []
        return self.masks.item(i + row.index(word)) if word in row else None

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = array("i", self.encoder.of_word(word, self.mask(word))).tobytes()
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got


def _assemble(pieces, side: SideTable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces.value)
        words = _Words(encoder, side)
        for batch in batches:
            for same in by_block(batch):
                words.open(same.column("block")[0].as_py())
                for part, _, _ in slices(same, "text", ASSEMBLED_BYTES):
                    ids, bounds = words.of_texts(part.column("text"))
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                    rest = [n for n in part.schema.names if n not in ("block", "ord")]
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), lists, encoder.decode_all(ids, bounds)], names=[*rest, "pieces", "decoded"])
                    pa.default_memory_pool().release_unused()

    return run


def encode_texts(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, text, pieces, decoded): the ids of every whole text, and the text read back from the ids alone.

    ``decoded`` equals the text unless that has the model's own space mark, which the model can't tell from a space.
    Null and empty texts have no pieces; long words are encoded whole; repeated rows are encoded each; extra columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = pieces or Pieces.load(MODEL)
    small_batches(spark)
    docs = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "pieces")
    rows = placed(docs)
    shared = spark.sparkContext.broadcast(pieces)
    lists = written(rows.mapInArrow(_vocabulary(shared), "block long, word string"), "pieces")
    distinct = lists.select("word").distinct()
    masks = segment_words(distinct, pieces)
    side = SideTable(lists.join(masks, "word").select("block", "word", "mask"), "pieces", ["word"])
    return rows.mapInArrow(_assemble(shared, side), "doc_id long, text string, pieces array<int>, decoded string")


def decode_pieces(encoded: DataFrame, pieces: Pieces | None = None, column: str = "pieces") -> DataFrame:
    """The rows with a column ``decoded`` of the texts that ids stand for; null ids give null."""
    pieces = pieces or Pieces.load(MODEL)
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(column).to_pylist()]
            kept = [n for n in batch.schema.names if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(texts, pa.string())], names=[*kept, "decoded"])

    schema = encoded.drop("decoded").schema
    return encoded.mapInArrow(run, schema.add("decoded", "string"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the check of its round trip."""
    encoded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return encoded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"), "pieces")


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, text, n_pieces and the pieces of every document."""
    encoded = encode_texts(docs)
    return encoded.select("doc_id", "text", F.size("pieces").cast("long").alias("n_pieces"), "pieces")
