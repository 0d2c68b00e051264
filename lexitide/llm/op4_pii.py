"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping for each kind, and
always stay. Looser patterns propose further candidates: an address that is spelled out, a phone number in a
national form, a phone or card number that stands beside other digits, an IPv6 address. Each candidate, base ones included, gets votes
(yes, no, abstain) of five labelers: pattern, check digits or structure, gazetteer, context words,
and boundary. The votes are counted by pattern of votes in Spark: at most kinds x 3^5 rows, however large the
corpus. Expectation-maximisation over these counts estimates every labeler's reliabilities, and how often base spans
and further candidates are right, apart: nearly all base spans are, which says nothing about the others. Abstentions say nothing. The
posteriors label a bounded sample of distinct candidates (at most SAMPLE rows with the smallest hashes, each counted as
often as it occurs), on which a logistic span classifier over shape and context features is trained. Base spans, further candidates and
all patterns of votes, these with the posteriors that the reliabilities give them, weigh as SHARES says; so votes that no
sampled candidate got, such as a context word against it, count as the labelers' reliabilities want. The classifier alone decides about candidates that
aren't base spans.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Every input row gives one
output row, whatever its doc_id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm.bounds import sample as bounded
from lexitide.runtime import Scratch, bound_batches, table

KINDS = ("email", "ip", "card", "phone")
LABELERS, SAMPLE, FEATURES, ACCEPT = 5, 20_000, 1 << 10, 0.9
#: Weights of base spans, further candidates and patterns of votes in training; of the votes that a labeler is worth a priori, the share of all candidates.
SHARES, TRUST = (0.2, 0.3, 0.5), 0.02

# A run of digits is tried at its start only: each pattern takes it to its end or fails at every digit of it.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GOES_ON, _CAME_FROM = re.compile(r"[ -][0-9]"), re.compile(r"[0-9][ -]$")

_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?(?:dot|DOT|\.) ?[\])}]) ?[A-Za-z0-9-]{1,63})+")
_LOOSE = (
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")),
    (2, re.compile(r"(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[0-9]{3}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9])")),
    (3, re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+(.])(?:\(0[0-9]{1,4}\) ?|0[0-9]{1,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+(.])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])")),
)

#: What the base patterns find inside a looser span; if they drop it by their check, it isn't right by itself either.
_STRICT = (None, _IP, _CARD, _PHONE)

# Gazetteers and context words of the labelers.
TOP_DOMAINS = frozenset("com net org edu gov mil int info biz io de fr es it uk us eu ch at nl be pl ru jp cn br in ca au".split())
CONTEXT_YES = {
    0: frozenset("mail email e-mail contact write reply an courriel correo kontakt".split()),
    1: frozenset("ip host server address addr login from adresse serveur".split()),
    2: frozenset("card visa mastercard amex credit debit carte karte tarjeta payment".split()),
    3: frozenset("phone tel telephone call fax mobile cell telefon téléphone teléfono".split()),
}
CONTEXT_NO = frozenset("isbn issn doi ean sku barcode version release build order invoice ticket serial tracking reference ref account model patent part item date page pages fig figure section no nr id".split())

Span = tuple[int, int, int]  # start, kind, end: sorts as the result wants it


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def emails(text: str) -> list[Span]:
    """As the pattern's leftmost matches, from one @ to the next, backwards from each: a long run without @ costs nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start, width = at, 64
        while start > end:  # the part before @ is nearly always short; no character is read more than twice
            low = max(end, start - width)
            run = _LOCAL.match(text[low:start][::-1]).end()
            start -= run
            if start > low:
                break
            width *= 2
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> list[Span]:
    if not text:
        return []
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def candidates(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and further candidates that overlap neither them nor each other."""
    base = base_spans(text)
    if not text:
        return base, []
    more: list[Span] = []
    if any(c in text for c in "[({"):
        more += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)] if re.search(r"[\[({] ?(?:at|AT|@) ?[\])}]", text) else []
    if _DIGIT.search(text):
        more += [(m.start(), k, m.end()) for k, p in _LOOSE for m in p.finditer(text)]
    return base, _apart(more, base) if more else []


def _apart(more: list[Span], base: list[Span]) -> list[Span]:
    """Of more, earlier and longer spans first, those that meet no base span and no span taken before."""
    starts, ends = np.array([s for s, _, _ in base], dtype=np.int64), np.maximum.accumulate(np.array([e for _, _, e in base], dtype=np.int64)) if base else np.zeros(0, np.int64)
    out, last = [], -1
    for s, k, e in sorted(set(more), key=lambda x: (x[0], -x[2], x[1])):
        i = int(np.searchsorted(starts, e, "left"))
        if s >= last and (i == 0 or ends[i - 1] <= s):
            out.append((s, k, e))
            last = e
    return out


def address_like(own: str) -> int:
    """1 if the parts of a mail address are well-formed, spelled out or not: no stray dots or hyphens, a last part of letters."""
    plain = re.sub(r" ?[\[({]? ?(?:dot|DOT) ?[\])}] ?", ".", re.sub(r" ?[\[({] ?(?:at|AT|@) ?[\])}] ?", "@", own)).replace(" ", "")
    name, _, domain = plain.partition("@")
    parts = domain.split(".")
    good = name and name[0] != "." and name[-1] != "." and ".." not in name and len(name) <= 64
    return int(bool(good and len(parts) > 1 and parts[-1].isalpha() and len(parts[-1]) > 1 and all(p and p[0] != "-" and p[-1] != "-" and len(p) <= 63 for p in parts)))


def votes(text: str, span: Span, is_base: bool) -> list[int]:
    """1 yes, 0 no, -1 abstains: pattern, structure, gazetteer, context, boundary."""
    s, k, e = span
    own, d = text[s:e], _digits(text[s:e])
    before = re.findall(r"[\w-]+", text[max(0, s - 40) : s].lower())[-4:]
    pattern = 1 if is_base else 0 if _STRICT[k] and _STRICT[k].search(own) and all(b[1] != k for b in base_spans(own)) else -1
    # what nearly all candidates of a kind have is no vote for them
    if k == 0:
        structure = -1 if address_like(own) else 0
    elif k == 1:
        structure = (1 if own.count(":") == 7 else -1) if ":" in own else -1 if all(int(p) <= 255 for p in own.split(".") if p) else 0
    else:
        structure = int(luhn(d)) if k == 2 else -1 if 10 <= len(d) <= 15 else 0
    if k == 0:
        last = re.findall(r"[A-Za-z0-9-]+", own)[-1].lower()
        listed = 1 if last in TOP_DOMAINS else 0 if last.isdigit() else -1
    elif k == 1:
        listed = 0 if own.split(".")[0] in ("0", "00", "255") else 1 if own.startswith(("10.", "127.", "192.168.")) else -1
    elif k == 2:
        listed = -1 if d[:1] in tuple("3456") else 0
    else:
        listed = 1 if own[0] == "+" and d[:1] != "0" else -1
    context = 1 if CONTEXT_YES[k] & set(before) else 0 if CONTEXT_NO & set(before[-2:]) else -1
    # a number without + that goes on after a space or hyphen is part of a longer one
    longer = own[-1:].isdigit() and own[0] != "+" and (_GOES_ON.match(text, e) or _CAME_FROM.search(text[max(0, s - 2) : s]))
    edge = 0 if longer or (text[s - 1 : s] if s else "").isalnum() or text[e : e + 1].isalnum() else -1
    return [pattern, structure, listed, context, edge]


def features(text: str, span: Span) -> list[int]:
    """Numbers of the binary features of a span: its shape, its neighbours, words before it."""
    s, k, e = span
    own = text[s:e]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", own)))[:24]
    cls = lambda c: "-" if not c else "9" if c.isdigit() else "a" if c.isalpha() else c
    names = [f"k{k}", f"s{k}{shape}", f"n{k}{len(_digits(own))}", f"l{k}{min(len(own) // 4, 12)}", f"p{k}{cls(text[s - 1 : s] if s else '')}", f"q{k}{cls(text[e : e + 1])}"]
    names += [f"v{k}{i}{v}" for i, v in enumerate(votes(text, span, False)[1:])]
    names += [f"w{k}{w}" for w in re.findall(r"[^\W\d_]{2,}", text[max(0, s - 40) : s].lower())[-3:] if w in CONTEXT_YES[k] or w in CONTEXT_NO]
    return sorted({crc32(n.encode()) % FEATURES for n in names})


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    reliability: dict

    def probability(self, active: list[int]) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weights[active].sum()))))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, strata: np.ndarray | None = None, trust: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of yes for each pattern of votes, P(vote | class) as [class, labeler, vote + 1], and the prior of each stratum.

    Labelers are taken as independent given the class; an abstention says nothing about it, and candidates that nobody votes on say nothing about
    the priors. Starts from the majority of the votes, where the number of the stratum counts as votes for yes;
    a labeler is worth trust votes a priori, nineteen of twenty of them right, so one that always abstains or agrees stays harmless."""
    strata = np.zeros(len(patterns), dtype=np.int64) if strata is None else strata
    p = np.clip(0.5 + 0.4 * np.sign((patterns == 1).sum(1) - (patterns == 0).sum(1) + strata - 0.5), 0.05, 0.95)
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    heard = counts * (patterns >= 0).any(1)
    for _ in range(rounds):
        w = np.stack([(1 - p) * counts, p * counts])
        theta = np.einsum("cn,njv->cjv", w, onehot) + trust * np.array([[0.05, 0.95, 0.05], [0.05, 0.05, 0.95]])[:, None, :]
        theta /= theta.sum(2, keepdims=True)
        prior = (np.bincount(strata, p * heard) + 1) / (np.bincount(strata, heard) + 2)
        p = posterior_of(patterns, theta, prior[strata])
    return p, theta, prior


def posterior_of(patterns: np.ndarray, theta: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(yes) of patterns of votes."""
    told = np.log(theta[:, :, 1:] / theta[:, :, 1:].sum(2, keepdims=True))
    odds = np.log(prior / (1 - prior)) + np.where(patterns == 1, told[1, :, 1] - told[0, :, 1], np.where(patterns == 0, told[1, :, 0] - told[0, :, 0], 0)).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def logistic(rows: list[list[int]], y: np.ndarray, share: np.ndarray, rounds: int = 400, rate: float = 0.4, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Accelerated full-batch gradient descent on soft labels over sparse binary rows; share are the rows' weights, one in all."""
    w = before = np.zeros(FEATURES + 1)  # the last is the bias
    if not rows:
        return w[:-1], -10.0
    at, feature = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.array(r, dtype=np.int64) for r in rows])
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - before)
        z = ahead[-1] + np.bincount(at, ahead[feature], len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        before, w = w, ahead - rate * np.append(np.bincount(feature, g[at], FEATURES) + decay * ahead[:-1], g.sum())
    return w[:-1], float(w[-1])


def _told(kind: int, told: tuple) -> list[int]:
    """The features that say what labelers other than the pattern voted."""
    return sorted({crc32(n.encode()) % FEATURES for n in (f"k{kind}", *(f"v{kind}{i}{v}" for i, v in enumerate(told)))})


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """EM over the counts of vote patterns of all candidates, then the classifier on a bounded sample."""
    spark = docs.sparkSession
    bound_batches(spark)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple = ([], [], [], [])
            for text in b.column("text").to_pylist():
                base, more = candidates(text)
                for is_base, spans in ((True, base), (False, more)):
                    for span in spans:
                        near = text[max(0, span[0] - 60) : span[2] + 2]
                        for c, v in zip(cols, (span[1], votes(text, span, is_base), features(text, span), crc32(near.encode()))):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.int64())], ["kind", "votes", "features", "key"])

    scratch = Scratch(spark, "pii")
    found = scratch.save(docs.select("text").mapInArrow(propose, "kind int, votes array<int>, features array<int>, key long"), "candidates")
    tally = found.groupBy("kind", "votes").count().collect()  # at most kinds x 3^LABELERS rows
    posterior, reliability, taught = {}, {}, []
    for kind in range(len(KINDS)):
        own = [r for r in tally if r["kind"] == kind]
        if own:
            patterns, counts = np.array([r["votes"] for r in own]), np.array([r["count"] for r in own], dtype=float)
            base = patterns[:, 0] == 1
            patterns[base, 0] = -1  # that a span is a base one is in the prior of its stratum
            # a stratum without candidates gets the prior one half
            p, theta, prior = expectation_maximisation(np.vstack([patterns, np.full((2, LABELERS), -1)]), np.append(counts, [0.0, 0.0]), strata=np.append(base.astype(np.int64), [0, 1]), trust=max(2.0, TRUST * counts.sum()))
            posterior |= {(kind, tuple(r["votes"])): x for r, x in zip(own, p)}
            reliability[KINDS[kind]] = {"prior": prior, "vote_given_class": theta}
            told = np.array(list(product((-1,), *[(-1, 0, 1)] * (LABELERS - 1))))
            taught += [(_told(kind, v[1:]), x) for v, x in zip(told.tolist(), posterior_of(told, theta, prior[:1]))]
    # copies of one context count as often as they occur, but are one row of the sample
    apart = scratch.save(found.groupBy("key", "kind", "votes", "features").agg(F.count("*").alias("times")), "contexts")
    rows = bounded(apart, sample, "key", "kind", "votes", "features").collect()
    scratch.drop(found, apart)
    y = np.array([posterior[r["kind"], tuple(r["votes"])] for r in rows] + [x for _, x in taught])
    part = np.array([int(r["votes"][0] != 1) for r in rows] + [2] * len(taught), dtype=np.int64)
    times = np.array([float(r["times"]) for r in rows] + [1.0] * len(taught))
    times *= (np.array(SHARES) / np.maximum(np.bincount(part, times, 3), 1))[part]
    weights, bias = logistic([r["features"] for r in rows] + [f for f, _ in taught], y, times / times.sum() if len(times) else times)
    return Model(weights, bias, reliability)


def spans(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base, more = candidates(text)
    return base, sorted(base + [s for s in more if model.probability(features(text, s)) >= ACCEPT])


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the counts and the hash of the base spans, and all spans, for every row of docs."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, out = [[] for _ in KINDS], [], []
            for text in b.column("text").to_pylist():
                base, found = spans(text, model)
                for k in range(len(KINDS)):
                    n[k].append(sum(s[1] == k for s in base))
                digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                out.append(written(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array(digest), pa.array(out)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact(text: str | None, model: Model) -> str | None:
    """Spans become <KIND>; overlapping ones become the first one's."""
    found = spans(text, model)[1]
    out, end = [], 0
    for s, k, e in found:
        if s >= end:
            out += [text[end:s], f"<{KINDS[k].upper()}>"]
        end = max(end, e)
    return "".join([*out, text[end:]]) if found else text


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the spans of text replaced; all columns stay."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([redact(t, model) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return annotate(docs, fit(docs))


__all__ = ["KINDS", "Model", "annotate", "base_spans", "fit", "query", "redacted"]
