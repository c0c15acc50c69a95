"""SentencePiece encoding and decoding by shared-prefix Viterbi (operator 5).

The vocabulary comes from a given model file and is never trained. A text is cut into marked words: runs of spaces, written as
U+2581, each with the characters up to the next space; pieces do not cross marked words. A marked word is cut further at line feeds, which
no piece holds. Each Arrow batch sorts its distinct marked
words and walks them as a trie, depth first: a word keeps the forward states of the prefix that it shares with the word before.

* Unigram models: the state of a prefix is its best sum of piece scores and the last step to it.
* BPE models: their scores are merge ranks, not log probabilities, so no sum of them is maximal on the segmentation that the
  merges give. But each prefix has one such segmentation, and a sequence of pieces is it exactly when the merges leave
  every two neighbours as they are. So the state of a prefix is its last piece: the one piece that ends there and stands next to the last piece of
  what is before it. Ids equal the library's.

Characters that no piece covers become UTF-8 byte pieces. Exact round trip: a U+2581 in the text itself is always encoded as bytes, so it
is never mistaken for a space.
"""
from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, text_batches

MARK = "▁"

_loaded: dict = {}


# Stands for a U+2581 of the text while it is encoded; no decoded text holds a lone surrogate.
LITERAL = "\udfff"


class Vocabulary:
    """Pieces of a model file: scores by string, byte ids, and bytes by id. ``kind`` is ``bpe`` or ``unigram``; by default it is told
    from the scores, which are whole numbers (minus the rank) in a BPE model."""

    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[float, int]] = {}
        self.byte_ids: dict[int, int] = {}
        self.bytes: list[bytes] = []
        scores = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(MARK, " ").encode("utf-8"))
                scores.append(model.get_score(i))
                if MARK not in piece.lstrip(MARK):  # pieces of one marked word only
                    self.scores[piece] = (model.get_score(i), i)
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces; encoding would lose characters")
        ranks = all(x == int(x) and x <= 0 for x in scores)
        self.kind = kind or ("bpe" if ranks else "unigram")
        self._index()

    def _index(self):
        self.longest = max(map(len, self.scores))
        # lengths of the pieces that end in the same three characters, longest first; shorter pieces are always tried
        lengths: dict[str, set[int]] = {}
        for piece in self.scores:
            if len(piece) > 2:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {end: (*sorted(n, reverse=True), 2, 1) for end, n in lengths.items()}
        self.known: dict[str, tuple[int, ...]] = {}
        # a line feed that stands in no piece ends a marked word: the parts meet more equals
        feed = "" if any("\n" in piece for piece in self.scores) else "\n"
        self.units = re.compile(f"{MARK}+[^{MARK}{feed}]*" + (f"|{feed}|[^{MARK}{feed}]+" if feed else ""))
        self.steps = {piece: (i,) for piece, (_, i) in self.scores.items()}
        # a character without a piece is worse than any piece
        self.lone_score = min(s for s, _ in self.scores.values()) - 10
        self.pairs: dict[tuple[str, str], bool] = {}

    def lone(self, char: str) -> tuple[int, ...]:
        """Byte pieces of a character that has no piece of its own."""
        return tuple(self.byte_ids[x] for x in (MARK if char == LITERAL else char).encode("utf-8"))

    def merged(self, text: str) -> list[str]:
        """Segmentation by merges: the best-ranked neighbours become one, the leftmost first among equals, until none can."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.scores.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stand(self, left: str, right: str, most: int = 200_000) -> bool:
        """Whether merges leave the two pieces as they are (``left`` empty: the one piece). Up to ``most`` answers are remembered."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= most:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _by_scores(word: str, keep: int, state: list, v: Vocabulary) -> None:
    """States ``(best score, steps)`` of the first ``d`` characters; on equal scores the longer last piece wins."""
    scores, lengths, short = v.scores, v.lengths, (2, 1)
    for d in range(keep + 1, len(word) + 1):
        top, step = state[d - 1][0] + v.lone_score, None
        for n in lengths.get(word[d - 3 : d], short) if d > 2 else short:
            if n > d:
                continue
            found = scores.get(word[d - n : d])
            if found is not None:
                total = state[d - n][0] + found[0]
                if step is None or total > top:
                    top, step = total, (state[d - n][1], (found[1],))
        state.append((top, (state[d - 1][1], v.lone(word[d - 1])) if step is None else step))


def _by_merges(word: str, keep: int, state: list, v: Vocabulary) -> None:
    """States ``(last piece, steps)`` of the merged segmentation of the first ``d`` characters."""
    steps, lengths, short, pairs = v.steps, v.lengths, (2, 1), v.pairs
    for d in range(keep + 1, len(word) + 1):
        for n in lengths.get(word[d - 3 : d], short) if d > 2 else short:
            if n > d:
                continue
            piece = word[d - n : d]
            step = steps.get(piece)
            if step is None:
                continue
            before, way = state[d - n]
            stands = pairs.get((before, piece))
            if v.stand(before, piece) if stands is None else stands:
                state.append((piece, (way, step)))
                break
        else:  # a character without a piece
            state.append((word[d - 1], (state[d - 1][1], v.lone(word[d - 1]))))


def encode_words(words: list[str], v: Vocabulary) -> list[tuple[int, ...]]:
    """Segmentation of each of the sorted, distinct marked words. States are cut back to the common prefix when the next word comes; their steps are
    linked lists (the steps before, the last ids), so that prefixes share them."""
    forward, first = (_by_merges, "") if v.kind == "bpe" else (_by_scores, 0.0)
    state, last, out = [(first, None)], "", []
    for word in words:
        keep = 0
        for a, b in zip(last, word):
            if a != b:
                break
            keep += 1
        del state[keep + 1 :]
        forward(word, keep, state, v)
        way, parts = state[-1][1], []
        while way is not None:
            way, part = way
            parts.append(part)
        parts.reverse()
        out.append(parts[0] if len(parts) == 1 else tuple(chain.from_iterable(parts)))
        last = word
    return out


def _encode_batch(texts: list[str | None], v: Vocabulary, memory: int = 150_000):
    """Ids of all texts as one flat array, with the offsets of the texts and their numbers of words (spaces and one).

    A worker remembers the words it has encoded, up to ``memory`` of at most 64 characters; it forgets all when more come.
    """
    words, units, counts, number = [], [], [], {}
    for t in texts:
        own = v.units.findall(MARK + t.replace(MARK, LITERAL).replace(" ", MARK)) if t else []
        counts.append(t.count(" ") + 1 if t else 0)
        units.append(len(own))
        words.extend([number.setdefault(w, len(number)) for w in own])
    if len(v.known) > memory:
        v.known.clear()
    order = sorted(w for w in number if w not in v.known)
    fresh = dict(zip(order, encode_words(order, v)))
    found = [fresh.get(w) or v.known[w] for w in number]
    v.known.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
    start, at = np.cumsum(sizes) - sizes, np.array(words, np.int64)
    n = sizes[at]
    ends = np.cumsum(n)
    ids = flat[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(units)]).astype(np.int64)]
    return ids, edges, counts


def decode_ids(ids, v: Vocabulary) -> str:
    """Text of a sequence of ids: piece strings with marks as spaces, byte pieces as UTF-8, first space dropped."""
    raw = b"".join(map(v.bytes.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _nullable(arrays, mask):
    return pa.ListArray.from_arrays(pa.array(arrays[0], pa.int32(), mask=mask), pa.array(arrays[1], pa.int32()))


def _encoder(text_col: str, path: str, out: str, rows: int):
    def run(batches):
        v = vocabulary(path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = batch.column(text_col).to_pylist()
                ids, edges, counts = _encode_batch(texts, v)
                gone = np.array([t is None for t in texts] + [False])
                lists = _nullable((edges, ids), gone)
                names = [n for n in batch.schema.names if n not in (out, f"{out}_words")]
                columns = [batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, lists, pa.array(counts, pa.int64())], [*names, out, f"{out}_words"]
                )

    return run


def _decoder(ids_col: str, path: str, out: str):
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            lists = batch.column(ids_col)
            flat, edges = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            texts = [decode_ids(flat[a:b].tolist(), v) if ok else None for a, b, ok in zip(edges[:-1], edges[1:], valid)]
            names = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(texts, pa.string())], [*names, out])

    return run


def _schema(df: DataFrame, **new: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in new.items()])


def encode(docs: DataFrame, model_file: str, text_col: str = "text", out: str = "ids", rows: int = 1000) -> DataFrame:
    """``docs`` with ``out`` (array of ids) and ``<out>_words`` (long, spaces and one).

    Null text: null ids, zero words; empty text: no ids. Rows are independent (no shuffle) and texts are encoded
    whole; repeated rows get equal ids; an empty table gives no rows. ``rows`` bounds the texts that share a
    trie. Other columns pass through; those named like the new ones are replaced. ``model_file`` must be readable on
    every executor.
    """
    text_batches(docs.sparkSession)
    return docs.mapInArrow(_encoder(text_col, model_file, out, rows), _schema(docs, **{out: T.ArrayType(T.IntegerType()), f"{out}_words": T.LongType()}))


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text ``out`` of its ids (null for null, empty for none)."""
    return encoded.mapInArrow(_decoder(ids_col, model_file, out), _schema(encoded, **{out: T.StringType()}))


def default_model(folder: str | None = None) -> str:
    """The SentencePiece file in a folder of public vocabulary files (default: the environment's, ``RANKFRAME_TOKENIZERS`` or ``/opt/tokenizers``)."""
    return f"{folder or os.environ.get('RANKFRAME_TOKENIZERS', '/opt/tokenizers')}/piece_bpe_32k.model"


def encode_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """Ids of every document and whether decoding them gives the text back."""
    text_batches(docs.sparkSession, rows=2500)
    kept = docs.select("doc_id", "text")
    encoder, decoder = _encoder("text", model_file, "ids", 2500), _decoder("ids", model_file, "decoded")
    new = {"ids": T.ArrayType(T.IntegerType()), "ids_words": T.LongType(), "decoded": T.StringType()}
    # both in one pass: one Python worker for each task instead of two
    both = kept.mapInArrow(lambda batches: decoder(encoder(batches)), _schema(kept, **new))
    return both.select(
        "doc_id",
        F.col("ids_words").alias("n_words"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        "ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op5_sentencepiece(spark, sf_dir) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), default_model())
