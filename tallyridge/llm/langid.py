"""Language identification by cross-parsing.

Each language has a reference text and its suffix automaton. A document is parsed greedily into the
longest phrases that occur in the reference; the language with the fewest phrases, each weighed by the
logarithm of the reference's length and divided by the document's length, wins. The automata of all
languages are one table of transitions in which a mismatch already leads to the start of the next
phrase, so that many blocks of text take a step together. Long texts are parsed in blocks of
``BLOCK`` symbols side by side, and phrases are then carried over the blocks' ends, so that counts are
those of one parse of the whole text.

Symbols are bytes of UTF-8, so that letters of any script differ; each language's part of the table has those
that its reference holds, and one for all others. Case is folded, and a run of characters other than letters counts as one gap. Null texts, and texts without a letter, are ``und``
with score 0. Languages come from the training rows alone; with none, all rows are ``und``.
Ties go to the language first in alphabetical order. Repeated rows and null ids are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import count as count_from

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.llm.common import STEPS, row_order, share

BLOCK, GAP, PAD = 1024, 0x20, 0xFF  # UTF-8 has no byte 0xFF


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of an id's decimal digits, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # of each byte, by language
    table: np.ndarray  # where the next state's row begins << 1 | whether a phrase ended
    starts: np.ndarray  # where each language's rows begin
    weights: np.ndarray  # bits that a phrase of each language takes

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        gap = ~letters()[points]
        points = np.where(gap, GAP, points)[~(gap & np.append(False, gap[:-1]))]
        return np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)

    def parse(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ended in, and the last state of, each column of ``text`` (steps x blocks) in each language, from the start."""
        state = np.repeat(self.starts[:, None], len(size), axis=1).astype(self.table.dtype)
        count = np.zeros_like(state)
        order = np.argsort(-size, kind="stable")
        for lo in range(0, len(order), 4096):
            some = order[lo : lo + 4096]
            columns, own, ended = text[:, some], state[:, some], count[:, some]
            active = np.searchsorted(-size[some], -np.arange(size[some[0]]), side="left")  # blocks longer than t
            for t, n in enumerate(active):
                step = self.table.take(own[:, :n] + self.classes.take(columns[t, :n], axis=1), mode="clip")
                ended[:, :n] += step & 1
                np.right_shift(step, 1, out=own[:, :n])
            state[:, some], count[:, some] = own, ended
        return count, state

    def follow(self, text: np.ndarray, size: np.ndarray, language: np.ndarray, block: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many more phrases end in blocks from state ``new`` than from ``old``, whether both differ at the end, and the new one there.

        A pair of a language and a block is left as soon as both states are one: from there on they parse alike.
        """
        more, old, new, left = np.zeros(len(old), np.int64), old.copy(), new.copy(), np.arange(len(old))
        for t in range(len(text)):
            left = left[(size[block[left]] > t) & (old[left] != new[left])]
            if not len(left):
                break
            symbol = self.classes[language[left], text[t, block[left]]]
            was, now = self.table[old[left] + symbol], self.table[new[left] + symbol]
            more[left] += (now & 1).astype(np.int64) - (was & 1)
            old[left], new[left] = was >> 1, now >> 1
        return more, old != new, new

    def phrases(self, rows: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language.

        Blocks of all texts are parsed side by side as if each began a text; then the state in which the one before has ended
        is followed into each block until it meets the parse that is there.
        """
        total = np.ones((len(rows), len(self.languages)), np.int64)
        owner = np.repeat(np.arange(len(rows)), [-(-len(r) // BLOCK) for r in rows])
        if not len(owner):
            return total
        blocks = [r[lo : lo + BLOCK] for r in rows for lo in range(0, len(r), BLOCK)]
        size = np.array([len(b) for b in blocks])
        text = np.full((int(size.max()), len(blocks)), PAD, np.uint8)
        for k, b in enumerate(blocks):
            text[: len(b), k] = b
        count, end = self.parse(text, size)
        begin = np.repeat(self.starts[:, None], len(blocks), axis=1).astype(end.dtype)
        goes_on = np.append(False, owner[1:] == owner[:-1])  # blocks with one before them in their text
        language, block = (x.ravel() for x in np.meshgrid(np.arange(len(self.languages)), np.flatnonzero(goes_on), indexing="ij"))
        for k in count_from(0):
            open_pairs = end[language, block - 1] != begin[language, block]
            language, block = language[open_pairs], block[open_pairs]
            if not len(block):
                break
            ready = np.arange(len(block))
            if k >= 2:  # the first open block of a text alone, so that what never meets costs no more than once through
                ready = np.unique(language * len(rows) + owner[block], return_index=True)[1]
            some, at = language[ready], block[ready]
            more, differ, last = self.follow(text, size, some, at, begin[some, at], end[some, at - 1])
            begin[some, at] = end[some, at - 1]
            count[some, at] += more
            end[some[differ], at[differ]] = last[differ]
            after = differ & np.append(goes_on, False)[at + 1]
            pairs = np.unique(np.concatenate((np.delete(language, ready) * len(owner) + np.delete(block, ready), some[after] * len(owner) + at[after] + 1)))
            language, block = np.divmod(pairs, len(owner))
        np.add.at(total, owner, count.T.astype(np.int64))
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        rows = [self.symbols(t) if t else np.empty(0, np.uint8) for t in texts]
        rows = [r if (r != GAP).any() else r[:0] for r in rows]
        lengths = np.array([max(1, len(r)) for r in rows])
        if not self.languages:
            return ["und"] * len(rows), [0.0] * len(rows)
        bits = self.phrases(rows) * self.weights / lengths[:, None]
        best = bits.argmin(axis=1)
        share = np.exp(-4 * (bits - bits.min(axis=1, keepdims=True)))
        score = share.max(axis=1) / share.sum(axis=1)
        return [self.languages[b] if len(r) else "und" for b, r in zip(best, rows)], [float(s) if len(r) else 0.0 for s, r in zip(score, rows)]


def build(references: dict[str, str]) -> Model:
    """A model from one reference text per language."""
    languages = sorted(references)
    model = Model(languages, np.zeros((len(languages), 256), np.int32), np.empty(0, np.int32), np.zeros(len(languages), np.int64), np.ones(len(languages)))
    tables, base = [], 0
    for k, language in enumerate(languages):
        symbols = model.symbols(references[language])
        own = np.unique(symbols)
        model.classes[k, own] = np.arange(1, len(own) + 1)  # 0: not in the reference
        nexts = suffix_automaton(model.classes[k, symbols].tolist())
        width = len(own) + 1
        table = np.full((len(nexts), width), base << 1 | 1, np.int64)
        for c, to in nexts[0].items():
            table[:, c] = (base + to * width) << 1 | 1
        for state, to in enumerate(nexts):
            if to:
                table[state, list(to)] = (np.fromiter(to.values(), np.int64) * width + base) << 1
        model.starts[k], model.weights[k] = base, np.log2(max(2, len(symbols)))
        base += table.size
        tables.append(table.ravel())
    if tables:
        model.table = np.concatenate([t.astype(np.int32 if base < 1 << 30 else np.int64) for t in tables])
    return model


def pieces(texts: list[str], chars: int) -> str:
    """The first part of each piece, all as long as fits into ``chars`` characters; short ones leave room to others."""
    left, cap = chars, 0
    for k, n in enumerate(sorted(map(len, texts))):
        cap = left // (len(texts) - k)
        if n > cap:
            break
        left, cap = left - n, n
    return "\n".join(t[: max(1, cap)] for t in texts)[: chars + len(texts)]


#: How much longer than its share of the reference a piece is cut, so that long texts fill what short ones leave.
ROOM = 4


def cut_piece(text: Column, order: Column, length: Column) -> Column:
    """``length`` characters from anywhere in a text, by a hash of its ``order``; shorter texts are whole."""
    start = F.pmod(F.xxhash64(order), F.greatest(F.length(text) - length, F.lit(0)) + 1) + 1
    return text.substr(start.cast("int"), length)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", language_chars: int = 24_000, sample_docs: int = 200) -> Model:
    """Learns from rows of ``docs`` (only training rows) that have a text and a language.

    The reference of a language has about ``language_chars`` at most, in pieces of some ``sample_docs`` of its rows, cut by a hash from anywhere in their
    texts. Rows are chosen and ordered by a hash of id and text, repeated rows once, whatever the size of the table.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    order = row_order(id_col, text_col)
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy(lang_col).agg(F.count("*"), F.approx_count_distinct(order, 0.01)).collect()}
    if not counts:
        return build({})
    # about one language per row of this table: fractions of rows to take, and characters of each
    shares = [(k, share(sample_docs, *n), min(language_chars, -(-ROOM * language_chars // max(1, min(sample_docs, n[1]))))) for k, n in counts.items()]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share double, chars int")
    taken = rows.select(F.col(lang_col).alias("lang"), order.alias("order"), F.col(text_col).alias("text")).join(F.broadcast(shares), "lang")
    sample = taken.where(F.pmod("order", F.lit(STEPS)) < F.col("share") * STEPS).select("lang", "order", cut_piece(F.col("text"), F.col("order"), F.col("chars")).alias("text")).dropDuplicates(["lang", "order"]).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["order"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return build({k: pieces(v, language_chars) for k, v in texts.items()})


def predict(spark: SparkSession, model: Model, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced)."""
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        found = shared.value
        for b in batches:
            languages, scores = [], []
            texts = b[text_col].to_pylist()
            for lo in range(0, len(texts), 2048):
                more = found.predict(texts[lo : lo + 2048])
                languages += more[0]
                scores += more[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def held_out_predictions(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's row per document; only rows outside the held-out third are learned from."""
    held = fold("doc_id", 3) == 1
    model = fit(docs.where(~held))
    return predict(spark, model, docs.select("doc_id", held.alias("held_out"), "text")).drop("text")
