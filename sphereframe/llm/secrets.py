"""Secret scans: base rules, and a character convolutional network over every candidate with its context.

A candidate is any run of LEAST key characters or more, dots within it included, whatever letters or digits it has; what
the base rules find is a candidate like any other.  The network sees each whole, in windows of INSIDE characters with SIDE
characters of text on each side, and takes the largest score.  It is trained on labelled findings: every distinct window of the
corpus, labelled by the base rules, and generated keys of public formats and strings that only look like them, one in
the context of each of these windows and GENERATED of either kind besides.  Documents are dealt to training,
calibration and a test by a hash of their text, and formats to training and to the other two, so calibration sees neither.
Shards of about SHARD windows are trained on in parallel, from what the first one gave, and their weights averaged.
Scores are calibrated by Platt scaling over all of the calibration part; the threshold is the highest that still finds
RECALL of its secrets, those that are no candidates counted as missed.  Network.report has recall and precision on the
test part.

Defined results: a null or empty text has no spans; a very long text is scanned whole; a repeated row gets its copy's
result; of base spans of one start the kind as listed comes first; an empty table gives an empty result.  The network
adds a span where its candidate is not part of a base span.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereframe.llm.common import fresh, materialize, table

KINDS = ("assign", "access", "hex", "network")
LEAST, INSIDE, SIDE = 12, 48, 16
GENERATED, RECALL, SEED = 3_000, 0.99, 5
#: Windows of a shard; those that the first shard is trained on, all epochs together; rounds over all shards after it.
SHARD, WARM, ROUNDS = 50_000, 100_000, 2
#: Ranges of scores that are counted at a time.
BINS = 1_000
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A run of key characters from its first to its last letter, digit, plus, slash or equals sign.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=](?:[A-Za-z0-9+/_=.-]*[A-Za-z0-9+/=])?")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
_SIGN = re.compile(r"[:=]")
_HINTS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    if _SIGN.search(text):
        low = text.lower()
        if any(h in low for h in _HINTS):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _RUN.finditer(text):
        if (m := _CANDIDATE.search(run[0])) and m.end() - m.start() >= LEAST:
            out.append((run.start() + m.start(), run.start() + m.end()))
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The candidate in pieces of INSIDE characters."""
    return [(at := max(start, min(x, end - INSIDE)), min(end, at + INSIDE)) for x in range(start, end, INSIDE)]


_WIDTH = INSIDE + 2 * SIDE
#: Classes of characters; 0 is all else, and what lies beyond the text.
_KINDS = ("aeiou", "nrtslhd", "cmpgbfvyw", "jkqxz", "AEIOU", "NRTSLHD", "CMPGBFVYW", "JKQXZ", "0123456789", "+/", "-_", ".", ":=", "\"'`", " \t\r\n", "@#<>{}[]()&?%$")
_CODE = np.zeros(128, np.uint8)
for _k, _chars in enumerate(_KINDS, start=1):
    _CODE[[ord(x) for x in _chars]] = _k
_CLASSES, _FILTERS, _SPAN = len(_KINDS) + 3, 24, 5


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], 0).astype(np.uint8)


def cut(code: np.ndarray, pieces: list[tuple[int, int]]) -> np.ndarray:
    """(pieces, _WIDTH + 1): the codes of each piece with its sides, and its length."""
    at = np.array(pieces, np.int64).reshape(-1, 2)
    padded = np.pad(code, (SIDE, INSIDE + SIDE))
    return np.c_[padded[at[:, :1] + np.arange(_WIDTH)], (at[:, 1] - at[:, 0])[:, None]].astype(np.uint8)


def encode(x: np.ndarray) -> np.ndarray:
    """(rows, _WIDTH, _CLASSES): one-hot character classes, whether inside the candidate, and changes of class inside."""
    kinds, n = x[:, :-1], x[:, -1:].astype(np.int64)
    place = np.arange(_WIDTH) - SIDE
    inside = (place >= 0) & (place < n)
    out = np.zeros((*kinds.shape, _CLASSES), np.float32)
    np.put_along_axis(out, kinds[..., None].astype(np.int64), 1, 2)
    out[..., -2] = inside
    out[:, 1:, -1] = inside[:, 1:] & inside[:, :-1] & (kinds[:, 1:] != kinds[:, :-1])
    return out


class Network:
    """One convolution, ReLU, maximum and mean over positions, one hidden layer; trained by Adam."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        n = 2 * _FILTERS
        self.p = [rng.normal(0, 0.2, (_SPAN * _CLASSES, _FILTERS)), np.zeros(_FILTERS), rng.normal(0, 0.2, (n, 16)), np.zeros(16), rng.normal(0, 0.2, 16), np.zeros(1)]
        self.p = [x.astype(np.float32) for x in self.p]
        self.slope, self.bias, self.threshold = 1.0, 0.0, 2.0
        self.report: dict[str, float] = {}

    def _forward(self, x: np.ndarray) -> tuple:
        k, b, w, c, v, d = self.p
        cut_ = np.lib.stride_tricks.sliding_window_view(x, _SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, _SPAN * _CLASSES)
        a = np.maximum(cut_ @ k + b, 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)], 1)
        h = np.maximum(pooled @ w + c, 0)
        return cut_, a, top, pooled, h, h @ v + d[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """x as of cut."""
        return np.concatenate([self._forward(encode(x[i : i + 256]))[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.004) -> None:
        rng, m, s, t = np.random.default_rng(SEED), [0 * p for p in self.p], [0 * p for p in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 128):
                own = order[i : i + 128]
                cut_, a, top, pooled, h, z = self._forward(encode(x[own]))
                k, b, w, c, v, d = self.p
                dz = (1 / (1 + np.exp(-z)) - y[own]) / len(own)
                dh = dz[:, None] * v * (h > 0)
                dp = dh @ w.T
                da = np.repeat(dp[:, None, _FILTERS:] / a.shape[1], a.shape[1], 1)
                np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :_FILTERS], 1)
                da *= a > 0
                flat = da.reshape(-1, _FILTERS)
                grads = [cut_.reshape(-1, cut_.shape[-1]).T @ flat, flat.sum(0), pooled.T @ dh, dh.sum(0), h.T @ dz, dz.sum(keepdims=True)]
                t += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    s[j] = 0.999 * s[j] + 0.001 * g * g
                    self.p[j] = (self.p[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.bias, -30, 30)))

    def found(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Of each text the candidates that the network takes for secrets; all texts are judged together."""
        spans = [candidates(t) for t in texts]
        rows, owner, pieces = [], [], 0
        for i, (t, own) in enumerate(zip(texts, spans, strict=True)):
            if own:
                each = [windows(*s) for s in own]
                rows.append(cut(codes(t), [w for e in each for w in e]))
                owner += [(i, k) for k, e in enumerate(each) for _ in e]
                pieces += len(rows[-1])
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if pieces and self.threshold <= 1:
            hits = np.flatnonzero(self.probability(self.logits(np.concatenate(rows)).astype(float)) >= self.threshold)
            for i, k in sorted({owner[j] for j in hits.tolist()}):
                out[i].append(spans[i][k])
        return out


def all_spans(texts: list[str], network: Network) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text the base spans, and all of them: the network's are those that are not part of a base span."""
    out = []
    for text, found in zip(texts, network.found(texts), strict=True):
        base = base_spans(text)
        out.append((base, sorted(base + [(a, 3, b) for a, b in found if not any(x <= a and b <= y for x, _, y in base)])))
    return out


def _random(rng: np.random.Generator, chars: str, n: int) -> str:
    return "".join(rng.choice(list(chars), n))


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Public formats of keys, as (prefix, alphabet, least and greatest length); a dot in the alphabet's place parts three runs.
KEYS = (
    ("ghp_", ALNUM, 36, 36), ("sk_live_", ALNUM, 24, 24), ("", ALNUM + "+/", 40, 40), ("eyJ", ALNUM + "-_.", 60, 160), ("", ALNUM, 24, 48), ("", ALNUM[:52], 20, 40), ("", ALNUM, 12, 20),
    ("", "0123456789ABCDEF", 32, 40), ("xoxb-", ALNUM + "-", 40, 50), ("AIza", ALNUM + "-_", 35, 35), ("glpat-", ALNUM, 20, 20), ("SG.", ALNUM + ".", 60, 66), ("npm_", ALNUM, 36, 36), ("", ALNUM + "+/", 24, 64),
)
#: Of KEYS, and of the kinds of other strings, those from this one on are not trained on.
UNSEEN_KEY, UNSEEN_OTHER = 8, 9


def _key(rng: np.random.Generator, kind: int) -> str:
    prefix, chars, least, most = KEYS[kind]
    body = _random(rng, chars.strip("."), int(rng.integers(least, most + 1)))
    if chars.endswith("."):
        a, b = sorted(rng.integers(12, len(body) - 8, 2).tolist())
        body = f"{body[:a]}.{body[a:b]}.{body[b:]}" if prefix != "SG." else f"{body[:22]}.{body[22:]}"
    return prefix + body


def _other(rng: np.random.Generator, kind: int) -> str:
    """A string that only looks like a key."""
    syllables = ["an", "er", "st", "tion", "or", "le", "pre", "con", "the", "ma", "ri", "ous", "ing", "de", "un", "ca", "ble", "ti", "el", "sub"]
    word = lambda n=3: "".join(rng.choice(syllables, int(rng.integers(2, n + 1))))
    n = lambda a, b: int(rng.integers(a, b))
    return [
        lambda: "-".join(word() for _ in range(n(3, 6))) + f"-{n(1, 99)}", lambda: "/".join(word() for _ in range(n(2, 6))) + f"/{n(1, 999)}", lambda: word(6) + word(6) + word(4),
        lambda: "_".join(word() for _ in range(n(2, 5))) + f"_{n(1, 30)}", lambda: f"{n(1990, 2035)}-{n(10, 13)}-{n(10, 29)}T{n(10, 24)}-{n(10, 60)}-{n(10, 60)}Z", lambda: _random(rng, "0123456789", n(12, 20)),
        lambda: ".".join(str(n(1, 255)) for _ in range(4)) + f".{n(100, 255)}", lambda: word() + word().capitalize() + word().capitalize() + word().capitalize(), lambda: (word(4) + word(4) + word()).upper(),
        lambda: f"www.{word()}{word()}.com/{word()}/{word()}.html", lambda: f"{n(1, 30)}/{n(1, 13)}/{n(1990, 2030)}-{n(1, 30)}/{n(1, 13)}/{n(1990, 2030)}", lambda: f"mail{n(1, 99)}.{word(4)}.org", lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}-{word()}.{n(1, 9)}",
        lambda: f"+{n(1, 99)}-{n(100, 999)}-{n(1000, 9999)}-{n(100, 999)}",
    ][kind]()


OTHERS = 14


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for x in b.column(0):
            t = x.as_py()
            if found := candidates(t):
                base, part, code = base_spans(t), xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) % 5, codes(t)
                for s, e in found:
                    secret = any(a < e and s < z for a, _, z in base)
                    rows += [(c.tobytes(), secret, part) for c in cut(code, windows(s, e))]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.bool_(), pa.int32()), strict=True)], ["piece", "secret", "part"])


LABELLED = "piece binary, secret boolean, part int"
#: at deals the rows to shards: a generated string goes where its context goes.
EXAMPLE = f"{LABELLED}, at bigint"
_KINDS_OF = (pa.binary(), pa.bool_(), pa.int32(), pa.int64())


def _plain() -> tuple[np.ndarray, np.ndarray]:
    """Sides of plain words."""
    plain = codes("".join(np.random.default_rng(SEED).choice(list("aeinorst  "), 2 * SIDE)))
    plain[SIDE - 1] = plain[SIDE] = _CODE[32]
    return plain[:SIDE], plain[SIDE:]


def _generated(rng: np.random.Generator, secret: bool, part: int, at: int, left: np.ndarray, right: np.ndarray) -> list[tuple]:
    """A string's windows between these codes; a key without candidates gives a row without a window."""
    seen, count = (UNSEEN_KEY, len(KEYS)) if secret else (UNSEEN_OTHER, OTHERS)
    string = (_key if secret else _other)(rng, int(rng.integers(0, seen) if part < 3 else rng.integers(seen, count)))
    code, found = np.concatenate([left, codes(string), right]), candidates(string)
    if not found and secret:
        return [(None, True, part, at)]
    return [(c.tobytes(), secret, part, at) for s, e in found for c in cut(code, windows(SIDE + s, SIDE + e))]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window, and one generated string in its place or, of three, in plain words."""
    plain = _plain()
    for b in batches:
        rows = []
        for piece, secret, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
            place, at = np.frombuffer(piece, np.uint8), xxhash.xxh3_64_intdigest(piece, part) >> 1
            rng = np.random.default_rng([SEED, at])
            kind = int(rng.integers(6))
            sides = plain if kind < 2 else (place[:SIDE], place[SIDE + int(place[-1]) :][:SIDE])
            rows += [(piece, secret, part, at), *_generated(rng, kind % 2 == 0, part, at, *sides)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS_OF, strict=True)], ["piece", "secret", "part", "at"])


def examples(docs: DataFrame, text: str) -> DataFrame:
    """piece, secret, part, at: every distinct window of each part, and the generated ones; stored."""
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    seen = texts.mapInArrow(_label, LABELLED).groupBy("piece", "part").agg(F.max("secret").alias("secret")).select("piece", "secret", "part")
    rng, plain, none, apart = np.random.default_rng(SEED), _plain(), (np.zeros(SIDE, np.uint8),) * 2, []
    for i in range(2 * GENERATED):
        apart += _generated(rng, i % 2 == 0, i // 2 % 5, i, *(plain if i % 3 else none))
    generated = docs.sparkSession.createDataFrame([(p and bytearray(p), *r) for p, *r in apart], EXAMPLE)
    return materialize(seen.mapInArrow(_examples, EXAMPLE).unionByName(generated))


def _pieces(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _WIDTH + 1)


def _average(rows: DataFrame, network: Network, epochs: int, rate: float) -> None:
    """rows: shard, at, piece, secret.  The network goes on over each shard by itself; its weights become their average."""
    shapes = [p.shape for p in network.p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, held, shard = 0.0, 0, [], None

        def done() -> None:
            nonlocal total, n, held
            own, x = Network(), np.concatenate([a for a, _ in held])
            own.p = [p.copy() for p in network.p]
            own.train(x, np.concatenate([b for _, b in held]).astype(np.float32), epochs, rate)
            total, n, held = total + len(x) * np.concatenate([p.ravel() for p in own.p]).astype(float), n + len(x), []

        for b in batches:
            shards, x, y = b.column(0).to_numpy(), _pieces(b.column(2)), b.column(3).to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(shards)) + 1):
                if len(part):
                    if held and shards[part[0]] != shard:
                        done()
                    held.append((x[part], y[part]))
                    shard = shards[part[0]]
        if held:
            done()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "at", "piece", "secret").mapInArrow(run, "n bigint, total binary").collect()
    flat = sum(np.frombuffer(r.total, float) for r in dealt) / sum(r.n for r in dealt)
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    network.p = [p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)]


def _scored(rows: DataFrame, network: Network) -> DataFrame:
    """part, secret, z: the logits, null for a key without candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = np.flatnonzero(b.column(0).is_valid().to_numpy(zero_copy_only=False))
            z = np.full(len(b), np.nan, np.float32)
            z[there] = network.logits(_pieces(b.column(0).take(pa.array(there))))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(z, pa.float32(), from_pandas=True)], ["part", "secret", "z"])

    return rows.mapInArrow(run, "part int, secret boolean, z float")


def _platt(scored: DataFrame, secrets: int, others: int) -> tuple[float, float]:
    """Slope and bias by Newton's method over all rows, with Platt's targets: no part is certain."""
    z, w = F.col("z").cast("double"), np.array([1.0, 0.0])
    y = F.when(F.col("secret"), (secrets + 1) / (secrets + 2)).otherwise(1 / (others + 2))
    for _ in range(20):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z * float(w[0]) + float(w[1])))))
        sums = scored.select((p * (1 - p)).alias("v"), (p - y).alias("e"), z.alias("z")).agg(*map(F.sum, (F.col("v") * F.col("z") * F.col("z"), F.col("v") * F.col("z"), F.col("v"), F.col("e") * F.col("z"), F.col("e")))).first()
        step = np.linalg.solve(np.array([[sums[0], sums[1]], [sums[1], sums[2]]]) + 1e-3 * np.eye(2), np.array([sums[3], sums[4]]) + 1e-3 * (w - [1, 0]))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _greatest(z: DataFrame, k: int) -> float:
    """The k-th greatest of z, by counts over ever narrower ranges, each dealt to BINS; no more than those are collected."""
    low, high = z.agg(F.min("z"), F.max("z")).first()
    while True:
        wide = (high - low) / BINS
        place = F.least(F.floor((F.col("z") - low) / wide), F.lit(BINS - 1)) if wide > 0 else F.lit(0)
        bins = z.where(F.col("z").between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).orderBy(F.desc("b")).collect()
        for r in bins:
            if k <= r.n:
                break
            k -= r.n
        if r.low == r.high:
            return float(r.low)
        low, high = r.low, r.high


def fit(docs: DataFrame, text: str) -> Network:
    """Trained on parts 0 to 2 of all examples; 3 calibrates, 4 is the test."""
    rows, network = examples(docs, text), Network()
    learnt = rows.where("part < 3 and piece is not null")
    trained = learnt.count()
    shards = -(-trained // SHARD)
    learnt = learnt.select(F.pmod("at", F.lit(shards)).alias("shard"), "at", "piece", "secret")
    first = learnt.where("shard = 0")
    _average(first, network, -(-WARM // max(1, first.count())), 0.004)
    for i in range(ROUNDS if shards > 1 else 0):
        _average(learnt, network, 1, 0.002 / (i + 1))
    scored = materialize(_scored(rows.where("part >= 3"), network))
    n = {(r.part, r.secret): (r.n, r.missed) for r in scored.groupBy("part", "secret").agg(F.count("z").alias("n"), F.sum(F.col("z").isNull().cast("long")).alias("missed")).collect()}
    (secrets, missed), (others, _) = n[3, True], n[3, False]
    own = scored.where("part = 3 and z is not null")
    network.slope, network.bias = _platt(own, secrets, others)
    rank = min(int(np.ceil(RECALL * (secrets + missed))), secrets)
    sign = 1.0 if network.slope >= 0 else -1.0
    z = sign * _greatest(own.where("secret").select((F.col("z") * sign).cast("double").alias("z")), rank)
    network.threshold = float(network.probability(np.array([z]))[0])
    said = F.col("z") * sign >= F.lit(z * sign)
    hits = {r.secret: r.n for r in scored.where("part = 4 and z is not null").where(said).groupBy("secret").agg(F.count("*").alias("n")).collect()}
    hit, wrong, all_ = hits.get(True, 0), hits.get(False, 0), sum(n[4, True])
    network.report = {"trained": trained, "calibrated": secrets + missed + others, "secrets": all_, "recall": hit / max(1, all_), "precision": hit / max(1, hit + wrong), "others": n[4, False][0], "others_said": wrong}
    return network


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: Characters of the texts that are judged together.
TOGETHER = 4_000_000


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def scan(docs: DataFrame, network: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, texts = [[], [], []], [], [], b.column(1).to_pylist()
            for start, end in _groups(texts):
                for base, every in all_spans(texts[start:end], network):
                    for k, c in enumerate(counts):
                        c.append(sum(s[1] == k for s in base))
                    digests.append(hashlib.sha256(_said(base).encode()).hexdigest())
                    spans.append(_said(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(apply, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and network spans of every whole text of documents.

    Null and empty texts have none; very long texts are scanned whole; repeated rows get equal results; an empty table gives
    no rows.  Only doc_id and text are read, so other columns cannot clash.
    """
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs, "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets replaced by a mark; n_chars follows the text.

    Null and empty texts stay as they are; very long ones are redacted whole; repeated rows alike; an empty table stays
    empty; columns of any names are kept.
    """
    network, own = fit(docs, "text"), fresh(docs, "_redacted")

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001
        import pandas as pd

        whole = [t or "" for t in texts]
        spans = [every for start, end in _groups(whole) for _, every in all_spans(whole[start:end], network)]
        return pd.Series([None if t is None else redact(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    out = docs.withColumn(own, clean("text"))
    changed = {c: F.col(own) if c == "text" else F.when(F.col(own) != F.col("text"), F.length(own)).otherwise(F.col(c)).cast(docs.schema[c].dataType) for c in docs.columns if c in ("text", "n_chars")}
    return out.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
