"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IPv4 addresses, card and phone numbers. The field then labels every chunk
of tokens with a digit or an ``@`` (a run of such tokens between other words) as one of these kinds or as
nothing. Its unary potentials are a softmax over the chunk's form and the word before it; neighbouring
chunks are linked in a chain, and chunks of a document that repeat, or that end in the same eight
digits, are linked over any distance. What patterns have found is evidence; loopy belief propagation
carries it along the links, so that a number written once with its country code is also found where
it is written without, however often it stands there. Chunks that no link joins to evidence get no label. Every chunk is
linked to one piece of evidence of each kind among those like it, or to the first of them where there is none, so that links
grow with the text and not with its square. Spans of the patterns always stay.

The potentials are learned from the patterns' own findings in at most about ``most_docs`` documents,
chosen by a hash of id and text, repeated rows once; a chunk like a found one but not found itself counts as unlabelled there.
Null texts have no spans; null and repeated ids are kept, one result per row. Offsets count code
points, ends are exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.llm.common import bounded_sample, row_order

#: Order of kinds in results.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

MARK = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no match starts inside a run of digits: the run's own start would have matched as well
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TOKEN = re.compile(r"\S+")
EDGES = " \t\r\n.,;:!?\"'<>[]{}|="
BUCKETS = 64
#: Chunks of a document from which unary potentials are learned.
MOST_EXAMPLES = 400
#: Ends belief propagation where messages swing and never settle.
MOST_ROUNDS = 1_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, each found from its ``@``, in time linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find, by kind and start."""
    if not MARK.search(text):
        return []
    out = [("email", s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


@dataclass
class Node:
    start: int
    end: int
    key: str  # digits, or the folded text of a chunk with few of them
    features: list[int]
    label: int  # of a span of the patterns in it, else 0


def word_bucket(word: str) -> int:
    h = 0
    for c in word.lower()[:16]:
        h = (h * 31 + ord(c)) & 0xFFFFFF
    return h % BUCKETS


#: Counts up to which a feature's buckets reach.
DIGIT_STEPS = (0, 1, 4, 8, 10, 12, 16, 20)
FEATURES = 1 + len(DIGIT_STEPS) + 5 + 6 + BUCKETS


def features(core: str, before: str, digits: str) -> list[int]:
    """Indexes of the features that a chunk has."""
    dots = min(core.count("."), 4)
    step = sum(len(digits) >= x for x in DIGIT_STEPS) - 1
    at = 1 + len(DIGIT_STEPS)
    out = [0, 1 + step, at + dots]
    at += 5
    flags = ("@" in core, core.startswith("+"), "(" in core, "-" in core, any(c.isalpha() for c in core), " " in core)
    out += [at + k for k, x in enumerate(flags) if x]
    return [*out, at + len(flags) + word_bucket(before)]


def chunks(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of tokens with a digit or an ``@``, one blank apart, in time linear in the text."""
    lo = hi = -2
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if not MARK.search(text, start, end):
            continue
        if hi > 0 and start == hi + 1 and text[hi] == " ":
            hi = end
            continue
        if hi > 0:
            yield lo, hi
        lo, hi = start, end
    if hi > 0:
        yield lo, hi


def nodes(text: str, spans: list[tuple[str, int, int]]) -> list[Node]:
    """Chunks in order of the text."""
    out = []
    spans = sorted(spans, key=lambda s: s[1])
    at = 0
    for lo, hi in chunks(text):
        while at < len(spans) and spans[at][2] <= lo:
            at += 1
        inside = [s for s in takewhile(lambda s: s[1] < hi, map(spans.__getitem__, range(at, len(spans)))) if s[2] > lo]
        # what stands between spans in a chunk is a node of its own
        cuts, p = [], lo
        for kind, s, e in inside:
            if s >= p:
                cuts += [(p, s, 0), (s, e, LABELS.index(kind))]
                p = e
        before = text[max(0, lo - 24) : lo].split()
        for s, e, label in [*cuts, (p, hi, 0)]:
            core = text[s:e]
            if not label:
                s += len(core) - len(core.lstrip(EDGES))
                core = core.strip(EDGES)
                if not MARK.search(core):
                    continue
            digits = NOT_DIGIT.sub("", core)
            key = digits if len(digits) >= 7 else core.lower()
            out.append(Node(s, s + len(core), key, features(core, before[-1] if before else "", digits), label))
    return out


def similar_pairs(found: list[Node]) -> list[tuple[int, int]]:
    """Skip links: each chunk to the hubs of those with its key, and of those whose last eight digits are its own.

    Hubs are the first chunk of each label that patterns gave, or the first of all where they gave none."""
    groups: dict[str, list[int]] = {}
    for k, n in enumerate(found):
        groups.setdefault(n.key, []).append(k)
        if n.key.isdigit() and len(n.key) >= 8:
            groups.setdefault("..." + n.key[-8:], []).append(k)
    pairs: dict[tuple[int, int], None] = {}
    for members in groups.values():
        hubs: dict[int, int] = {}
        for k in members:
            if found[k].label:
                hubs.setdefault(found[k].label, k)
        for hub in hubs.values() or members[:1]:
            for k in members:
                if k != hub:
                    pairs[min(k, hub), max(k, hub)] = None
    return list(pairs)


def evidence(found: list[Node]) -> list[set[int]]:
    """Labels that the patterns have given to chunks that are linked to each one, over one skip link or more."""
    group = list(range(len(found)))

    def top(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for i, j in similar_pairs(found):
        group[top(j)] = top(i)
    labels: dict[int, set[int]] = {}
    for k, n in enumerate(found):
        if n.label:
            labels.setdefault(top(k), set()).add(n.label)
    return [labels.get(top(k), set()) for k in range(len(found))]


@dataclass
class Field:
    """Log potentials."""

    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # labels x labels

    def posteriors(self, found: list[Node], rounds: int = MOST_ROUNDS) -> np.ndarray:
        """Beliefs of each chunk's labels by loopy belief propagation until messages settle; evidence is held."""
        scores = np.stack([self.unary[n.features].sum(axis=0) for n in found])
        for k, n in enumerate(found):
            if n.label:
                scores[k] = -1e9  # more than all who link to it can outvote
                scores[k, n.label] = 0.0
        skips = similar_pairs(found)
        edges = [(k, k + 1, 0) for k in range(len(found) - 1)] + [(i, j, 1) for i, j in skips]
        if edges:
            a, b, kind = map(np.array, zip(*edges))
            source, target = np.concatenate((a, b)), np.concatenate((b, a))
            potentials = np.stack((self.chain, self.skip))[kind]
            both = np.concatenate((potentials, potentials.transpose(0, 2, 1)))
            messages = np.zeros((len(source), len(LABELS)))
            reverse = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
            for _ in range(rounds):
                belief = scores.copy()
                np.add.at(belief, target, messages)
                out = belief[source] - messages[reverse]
                new = np.logaddexp.reduce(out[:, :, None] + both, axis=1)
                new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                if np.abs(new - messages).max() < 1e-4:
                    break
                messages = 0.5 * messages + 0.5 * new
            np.add.at(scores, target, messages)
        scores -= np.logaddexp.reduce(scores, axis=1, keepdims=True)
        return np.exp(scores)

    def added(self, text: str, base: list[tuple[str, int, int]], cutoff: float) -> list[tuple[str, int, int]]:
        """Spans of chunks that the patterns have missed."""
        found = nodes(text, base)
        if not any(n.label for n in found) or all(n.label for n in found):
            return []  # no evidence to carry, or nobody to carry it to
        reached = evidence(found)
        if not any(r and not n.label for n, r in zip(found, reached)):
            return []
        beliefs = self.posteriors(found)
        best = beliefs.argmax(axis=1)
        return [(LABELS[b], n.start, n.end) for n, b, p, r in zip(found, best, beliefs, reached) if b in r and not n.label and p[b] >= cutoff]


def softmax_weights(rows: list[list[int]], labels: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights of a softmax over binary features, by gradient steps on all rows."""
    x = np.zeros((len(rows), FEATURES))
    for k, r in enumerate(rows):
        x[k, r] = 1
    wanted = np.eye(len(LABELS))[labels]
    w = np.zeros((FEATURES, len(LABELS)))
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (x.T @ (p - wanted) / len(x) + decay * w)
    return w


def counted(found: list[Node], seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[tuple[list[int], int]]]:
    """Of a document's chunks: the labels that neighbours have, those that linked ones have, and features with labels of
    at most ``MOST_EXAMPLES`` chunks, chosen by a hash from the whole text; those with evidence are examples of their kind."""
    chain, skip = np.zeros((len(LABELS),) * 2, np.int64), np.zeros((len(LABELS),) * 2, np.int64)
    pairs = similar_pairs(found)
    unknown = {k for i, j in pairs for k, o in ((i, j), (j, i)) if not found[k].label and found[o].label}
    for k in range(len(found) - 1):
        if not {k, k + 1} & unknown:
            chain[found[k].label, found[k + 1].label] += 1
    for i, j in pairs:
        if not {i, j} & unknown:
            skip[found[i].label, found[j].label] += 1
            skip[found[j].label, found[i].label] += 1
    known = [k for k in range(len(found)) if k not in unknown]
    if len(known) > MOST_EXAMPLES:
        known = sorted(known, key=lambda k: (zlib.crc32(b"%d:%d" % (seed, k)), k))[:MOST_EXAMPLES]
    return chain, skip, [(found[k].features, found[k].label) for k in known]


def learn(counts: list[tuple[np.ndarray, np.ndarray, list[tuple[list[int], int]]]]) -> Field:
    """A field from what was counted in documents."""
    rows = [features for _, _, examples in counts for features, _ in examples]
    labels = [label for _, _, examples in counts for _, label in examples]
    chain = sum((c for c, _, _ in counts), np.ones((len(LABELS),) * 2))
    skip = sum((s for _, s, _ in counts), np.ones((len(LABELS),) * 2) * 0.1)
    y = np.array(labels, np.int64)
    # pointwise mutual information: links say nothing where labels are independent
    pmi = lambda n: np.log(n / n.sum()) - np.log(n.sum(1, keepdims=True) / n.sum()) - np.log(n.sum(0, keepdims=True) / n.sum())
    skip += np.eye(len(LABELS)) * 10  # a prior: what looks alike is alike
    return Field(softmax_weights(rows, y) if rows else np.zeros((FEATURES, len(LABELS))), pmi(chain), 3 * pmi(skip))


def fit(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", most_docs: int = 1_000) -> Field:
    """Learns from all chunks of documents with a digit or an ``@``; the driver gets counts, and examples as ``counted`` bounds them."""
    rows = docs.where(F.col(text_col).rlike("[0-9@]")).select(row_order(id_col, text_col).alias("order"), F.col(text_col).alias("text"))

    def chunks(batches):
        for b in batches:
            orders = b["order"].to_pylist()
            out = [counted(nodes(text, base_spans(text)), order) for order, text in zip(orders, b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    b["order"],
                    *(pa.array([x[k].ravel().tolist() for x in out], pa.list_(pa.int64())) for k in (0, 1)),
                    pa.array([[{"features": f, "label": y} for f, y in examples] for _, _, examples in out], pa.list_(pa.struct([("features", pa.list_(pa.int32())), ("label", pa.int32())]))),
                ],
                names=["order", "chain", "skip", "examples"],
            )

    got = bounded_sample(rows, most_docs).mapInArrow(chunks, "order long, chain array<long>, skip array<long>, examples array<struct<features:array<int>,label:int>>").collect()
    got.sort(key=lambda r: (r["order"], r["examples"]))
    matrix = lambda counts: np.array(counts).reshape(len(LABELS), len(LABELS))
    return learn([(matrix(r["chain"]), matrix(r["skip"]), [(list(x["features"]), x["label"]) for x in r["examples"]]) for r in got])


def all_spans(text: str | None, field: Field | None, cutoff: float) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """What the patterns find, and all spans, by kind and start."""
    base = base_spans(text) if text else []
    more = field.added(text, base, cutoff) if field and base else []
    both = sorted({*base, *more}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, both


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find(spark: SparkSession, docs: DataFrame, *, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.9) -> DataFrame:
    """``(id_col, base, spans)`` for each row: spans of the patterns alone, and all of them."""
    shared = spark.sparkContext.broadcast(field or fit(docs, text_col=text_col, id_col=id_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [all_spans(t, shared.value, cutoff) for t in b["text"].to_pylist()]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x[k]] for x in got], pa.list_(SPAN)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b["id"], *columns], names=["id", "base", "spans"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, base {spans}, spans {spans}")
    return found.withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first, then the longest."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, docs: DataFrame, *, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.9) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; other columns as they were."""
    shared = spark.sparkContext.broadcast(field or fit(docs, text_col=text_col, id_col=id_col))

    def run(batches):
        for b in batches:
            texts = [t and redacted(t, s) if (s := all_spans(t, shared.value, cutoff)[1]) else t for t in b[text_col].to_pylist()]
            k = b.schema.get_field_index(text_col)
            yield b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    found = find(spark, docs)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
