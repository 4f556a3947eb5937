"""Toxic spans and document scores by a linear-chain conditional random field.

The field has two tags, clean and toxic. Whether a token is toxic depends on its form, its
beginnings and endings, its shape next to the shape of the token before it, the forms on either
side, and on the tag before it; all weights are learned. Labels are of whole documents, so token
labels are soft: in a clean document all tokens are clean, in a toxic one at least one isn't, and
each has the chance that the field itself gives it. That is the likelihood of the document's
label, and its gradient needs nothing but forward-backward marginals; it is climbed by L-BFGS
with a quadratic prior. A share of labels (NOISE) is taken to be wrong. Copies of a document,
exact or near (by min-hash bands of its shingles), share the weight of one, and features that
come in fewer than LEAST_DOCUMENTS different documents are left out.

Scoring runs forward-backward over every whole text, all texts of a piece at once. A document's
score is the chance that at least one of its tokens is toxic, which is one less the product of
the chances that each token is clean, given that all before it are; its spans are neighbouring
tokens whose marginal is at least a half, with code point offsets.

The model is fitted on a bounded sample of the labelled rows: the TOXIC_ROWS toxic and the
CLEAN_ROWS clean ones that come first by a hash of the id, with their whole texts.

Edge cases: null and empty texts have no tokens, score 0 and no spans; very long texts are pieces
of their own, scored in time and memory in proportion to their length; a null label or a label
of no document teaches nothing; labels repeated for an id count once, as toxic if any is; a
table without labels of either kind gives scores of 0; repeated rows are scored each, and alike;
other columns aren't carried; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .tokens import Words, stirred

TOXIC_ROWS = 1000
CLEAN_ROWS = 1500
LEAST_DOCUMENTS = 5
#: Share of labels taken to be wrong.
NOISE = 0.02
#: Weight of the quadratic prior, in documents.
PRIOR = 0.06
STEPS = 40
PREFIXES = (3, 4, 5, 6)
SUFFIXES = (2, 3, 4)
PIECE_BYTES = 4_000_000
#: Tokens that are worked through one after the other; all such runs of a piece are worked through together.
RUN = 256
#: Steps between scalings, and bounds of a token's log odds: what lies between can't overflow.
SCALED, LOWEST, HIGHEST = 8, -60.0, 30.0
#: Copies: texts that share one of BANDS bands of ROWS least hashes of shingles of SHINGLE forms.
SHINGLE, BANDS, ROWS = 3, 10, 6
#: Tokens whose features a task remembers.
REMEMBERED = 400_000
_SEEDS = stirred(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))

_FORM = re.compile(r"\w+")
#: Shapes: case (none, lower, title, upper, other) by end (plain, sentence end, other mark); then the start of a text.
SHAPES = 16
START = 15


def _shape(letters: str, last: str) -> int:
    low, high = letters.lower(), letters.upper()
    case = 0 if low == high else 1 if letters == low else 3 if letters == high else 2 if letters[0] == high[0] and letters[1:] == low[1:] else 4
    return 3 * case + (0 if last.isalnum() else 1 if last in ".!?" else 2)


def shape_of(token: str) -> int:
    return _shape("".join(_FORM.findall(token)), token[-1:])


def form_of(token: str) -> str:
    return "_".join(_FORM.findall(token.lower()))


def features_of(token: str) -> list[str]:
    """A token's own features: the form, beginnings and endings of each run of word characters, and its shape."""
    return described(token)[0]


def described(token: str) -> tuple[list[str], str, int]:
    """A token's own features, its form and its shape."""
    runs = _FORM.findall(token)
    shape = _shape("".join(runs), token[-1:])
    forms = [r.lower() for r in runs]
    out = [f"#{shape}"]
    for form in forms if len(forms) < 2 else dict.fromkeys(forms):
        n = len(form)
        out.append(f"={form}")
        out += [f"^{form[:k]}" for k in PREFIXES if n >= k]
        out += [f"${form[-k:]}" for k in SUFFIXES if n >= k]
    return (out if len(forms) < 2 else list(dict.fromkeys(out))), "_".join(forms), shape


def sample_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``(id, toxic)`` of the bounded training sample: TOXIC_ROWS + CLEAN_ROWS rows at most."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    one = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    order = [F.xxhash64("id", F.lit(11)), "id"]
    return one.filter("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(one.filter("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))


def training_rows(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3) -> DataFrame:
    """``(id, text, toxic)`` of the sample. Rows whose crc32(id as text) mod ``folds`` is ``fold`` aren't in it."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    chosen = sample_labels(labels.filter(remainder != fold))
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return slim.join(F.broadcast(chosen), "id")  # TOXIC_ROWS + CLEAN_ROWS rows of two numbers at most


def bands_of(text: str) -> list[int]:
    """BANDS hashes of a text, each of ROWS least hashes of its shingles: copies share some, texts with one phrase in common none."""
    forms = _FORM.findall(text.lower())
    shingles = {" ".join(forms[i : i + SHINGLE]) for i in range(max(1, len(forms) - SHINGLE + 1))}
    hashes = np.fromiter((xxhash.xxh64_intdigest(x) for x in shingles), dtype=np.uint64, count=len(shingles))
    least = np.array([stirred(hashes ^ seed).min() for seed in _SEEDS], dtype=np.uint64).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), n) >> 1 for n, row in enumerate(least)]


def copy_groups(train: DataFrame) -> dict[int, int]:
    """The group of copies of each text of the sample (TOXIC_ROWS + CLEAN_ROWS rows at most), by the text's hash; texts that share a band are copies."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([_text_key(t) for t in texts], pa.int64()), pa.array([bands_of(t) for t in texts], pa.list_(pa.int64()))], ["key", "bands"])

    above: dict[int, int] = {}

    def top(x: int) -> int:
        above.setdefault(x, x)
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    first: dict[int, int] = {}
    rows = train.select("text").mapInArrow(sketch, "key long, bands array<long>").dropDuplicates(["key"]).collect()
    for r in rows:
        for band in r["bands"]:
            one, other = sorted((top(r["key"]), top(first.setdefault(band, r["key"]))))
            above[other] = one
    return {r["key"]: top(r["key"]) for r in rows}


def _text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) >> 1


class Marginals(NamedTuple):
    toxic: np.ndarray  # of each token, the chance of tag 1
    moves: np.ndarray  # of each token, the chances of tags [0, 1] and [1, 1] of the token before and of this one
    log_z: np.ndarray  # of each token, its part of the logarithm of the text's partition sum


def forward_backward(log_odds: np.ndarray, first: np.ndarray, moves: np.ndarray) -> Marginals:
    """Exact marginals of texts in turn: ``log_odds`` of tag 1 for each token, ``first`` marks the first token of each text.

    ``moves`` [tag before, tag] are logarithms; tag 0 all along weighs 1, and texts begin after a tag 0. The tokens are
    cut into runs of RUN. The 2 x 2 products over runs are made for all runs at once, a token of each at a time;
    they give the vectors at the ends of runs, and these all vectors within.
    """
    n = len(log_odds)
    runs = max(1, -(-n // RUN))
    x = np.zeros(runs * RUN)
    x[:n] = np.exp(np.clip(log_odds, LOWEST, HIGHEST))
    begins = np.ones(runs * RUN, dtype=bool)
    begins[:n] = first
    x, begins = np.ascontiguousarray(x.reshape(runs, RUN).T), np.ascontiguousarray(begins.reshape(runs, RUN).T)
    (_, m01), (m10, m11) = np.exp(moves)
    t01 = m01 * x
    t10 = np.where(begins, 1.0, m10)
    t11 = np.where(begins, t01, m11 * x)
    # Products over runs.
    a, b, c, d = np.ones(runs), np.zeros(runs), np.zeros(runs), np.ones(runs)
    for s in range(RUN):
        a, b, c, d = a + b * t10[s], a * t01[s] + b * t11[s], c + d * t10[s], c * t01[s] + d * t11[s]
        if s % SCALED == SCALED - 1:
            size = a + b + c + d
            a, b, c, d = a / size, b / size, c / size, d / size
    into, out = np.empty((runs, 2)), np.empty((runs, 2))
    u, v = 1.0, 0.0
    rows = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()))
    for i, (p, q, r, w) in enumerate(rows):
        into[i] = u, v
        u, v = u * p + v * r, u * q + v * w
        u, v = u / (u + v), v / (u + v)
    u, v = 1.0, 1.0
    for i in range(runs - 1, -1, -1):
        out[i] = u, v
        p, q, r, w = rows[i]
        u, v = p * u + q * v, r * u + w * v
        u, v = u / (u + v), v / (u + v)
    # Forward vectors: the chance of tag 1 given the tokens so far.
    forward, before, extra = np.empty_like(x), np.empty_like(x), np.empty_like(x)
    one = into[:, 1].copy()
    for s in range(RUN):
        before[s] = one
        zero = 1.0 - one
        ones = zero * t01[s] + one * t11[s]
        extra[s] = ones + one * (t10[s] - 1.0)
        one = ones / (1.0 + extra[s])
        forward[s] = one
    # Backward vectors, as the share of tag 1 in their sum.
    toxic, joint01, joint11 = np.empty_like(x), np.empty_like(x), np.empty_like(x)
    back = out[:, 1] / out.sum(1)
    for s in range(RUN - 1, -1, -1):
        clean = 1.0 - back
        hot = forward[s] * back
        toxic[s] = hot / (hot + (1.0 - forward[s]) * clean)
        from0, from1 = clean + t01[s] * back, t10[s] * clean + t11[s] * back
        total = (1.0 - before[s]) * from0 + before[s] * from1
        joint01[s] = (1.0 - before[s]) * t01[s] * back / total
        joint11[s] = before[s] * t11[s] * back / total
        back = from1 / (from0 + from1)
    flat = lambda y: y.T.reshape(-1)[:n]
    start = flat(begins)
    both0, both1 = flat(joint01), flat(joint11)
    # After the end of a text, tag 1 counts as tag 0.
    joint = np.stack([np.where(start, both0 + both1, both0), np.where(start, 0.0, both1)])
    return Marginals(flat(toxic), joint, np.log1p(flat(extra)))


class Tokens:
    """Texts as tokens of known features: ``own`` features of each distinct token, and one of it as a neighbour."""

    def __init__(self, texts: list[bytes | None], look_up: Callable[[bytes], tuple[list[int], int, int, int]]) -> None:
        words = Words(texts)
        looked = [look_up(w) for w in words.distinct]
        self.words = words
        self.sizes = np.array([len(x[0]) for x in looked], dtype=np.int64)
        self.own = np.fromiter((f for x in looked for f in x[0]), dtype=np.int64)
        left, right, shape = (np.array([x[i] for x in looked], dtype=np.int64) for i in (1, 2, 3))
        n = len(words.codes)
        self.first = np.zeros(n, dtype=bool)
        self.first[words.starts[words.counts > 0]] = True
        self.left, self.right, self.pair = np.full(n, -1), np.full(n, -1), np.full(n, START * SHAPES)
        if n:
            codes, inner = words.codes, ~self.first[1:]
            self.left[1:][inner] = left[codes[:-1]][inner]
            self.right[:-1][inner] = right[codes[1:]][inner]
            self.pair[1:][inner] = shape[codes[:-1]][inner] * SHAPES
            self.pair += shape[codes]

    def per_text(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.words.doc_of(), weights=x, minlength=len(self.words.counts))


class Field:
    """A linear-chain field of two tags: the weight of each feature, of pairs of shapes, of tag 1 as such, and of moves.

    Moves from tag 0 to 0 and from 1 to 0 weigh 0: any other weights say the same.
    """

    def __init__(self, features: dict[str, int]) -> None:
        self.features = features
        self.n = len(features)
        self.weights = np.zeros(self.n + SHAPES * SHAPES + 4)  # then: tag 1, moves [0, 1], [1, 0], [1, 1]
        self.weights[-4] = -7.0
        self._known: dict[bytes, tuple[list[int], int, int, int]] = {}

    def look_up(self, word: bytes) -> tuple[list[int], int, int, int]:
        """Numbers of a token's features, of it as the token before and as the token after another, and its shape."""
        found = self._known.get(word)
        if found is None:
            get = self.features.get
            names, form, shape = described(word.decode(errors="replace"))
            found = ([k for f in names if (k := get(f)) is not None], get(f"<{form}", -1), get(f">{form}", -1), shape)
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[word] = found
        return found

    def run(self, tokens: Tokens, weights: np.ndarray | None = None) -> Marginals:
        w = self.weights if weights is None else weights
        flat = np.append(w[: self.n], 0.0)  # number -1: no feature
        own = np.zeros(len(tokens.sizes))
        if len(tokens.own):
            some = tokens.sizes > 0
            own[some] = np.add.reduceat(flat[tokens.own], (np.cumsum(tokens.sizes) - tokens.sizes)[some])
        e = w[-4] + own[tokens.words.codes] + flat[tokens.left] + flat[tokens.right] + w[self.n : self.n + SHAPES * SHAPES][tokens.pair]
        return forward_backward(e, tokens.first, np.array([[0.0, w[-3]], [w[-2], w[-1]]]))

    def fit(self, tokens: Tokens, toxic: np.ndarray, shares: np.ndarray, steps: int = STEPS) -> Field:
        """Climb the likelihood of documents' labels; ``shares``: what each document counts."""
        docs = tokens.words.doc_of()
        type_of = np.repeat(np.arange(len(tokens.sizes)), tokens.sizes)

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            m = self.run(tokens, w)
            clean = np.exp(-tokens.per_text(m.log_z))
            says = NOISE + (1 - 2 * NOISE) * np.where(toxic == 1, 1 - clean, clean)
            pull = shares * (1 - 2 * NOISE) * clean / says * np.where(toxic == 1, 1.0, -1.0)
            each = pull[docs] * m.toxic
            by_type = np.bincount(tokens.words.codes, weights=each, minlength=len(tokens.sizes))
            g = np.zeros(len(w))
            g[: self.n] = np.bincount(tokens.own, weights=by_type[type_of], minlength=self.n)[: self.n]
            for side in (tokens.left, tokens.right):
                g[: self.n] += np.bincount(side + 1, weights=each, minlength=self.n + 1)[1 : self.n + 1]
            g[self.n : self.n + SHAPES * SHAPES] = np.bincount(tokens.pair, weights=each, minlength=SHAPES * SHAPES)
            g[-4], g[-3], g[-1] = each.sum(), (pull[docs] * m.moves[0]).sum(), (pull[docs] * m.moves[1]).sum()
            held = w.copy()
            held[-4] += 7.0
            return PRIOR / 2 * float(held @ held) - float((shares * np.log(says)).sum()), PRIOR * held - g

        self.weights = climbed(loss, self.weights, steps)
        return self


def climbed(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps: the weights of a low ``loss`` (value and gradient)."""
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, held = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            q -= a * y
            held.append(a)
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(past, reversed(held)):
            q += (a - (y @ q) / (s @ y)) * s
        rate, slope = 1.0, float(g @ q)
        while rate > 1e-6:
            new, new_g = loss(w - rate * q)
            if new <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = -rate * q, new_g - g
        done = value - new < 1e-4 * abs(value)
        w, value, g = w + s, new, new_g
        if s @ y > 1e-10:
            past = [*past[1 - memory :], (s, y)]
        if done:
            break
    return w


def document_features(text: str) -> set[str]:
    """All features of a text's tokens: their own, and each form as the one before and after another."""
    out: set[str] = set()
    for token in set(re.findall(r"[^\x20\x09-\x0D]+", text)):
        names, form, _ = described(token)
        out.update(names)
        if form:
            out.update((f"<{form}", f">{form}"))
    return out


def frequent_features(train: DataFrame, groups: dict[int, int], least: int = LEAST_DOCUMENTS) -> list[str]:
    """Features that come in ``least`` different documents of ``train(text)``, in order; copies (``groups``, by text) are one document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, set[str]] = {}
            for text in batch.column("text").to_pylist():
                seen.setdefault(groups[_text_key(text)], set()).update(document_features(text))
            for group, names in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array([group] * len(names), pa.int64())], ["feature", "document"])

    pairs = train.select("text").mapInArrow(emit, "feature string, document long").distinct()
    return sorted(r["feature"] for r in pairs.groupBy("feature").count().filter(F.col("count") >= least).select("feature").collect())


def fit(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field, or nothing where labels of a kind are missing. The sample's TOXIC_ROWS + CLEAN_ROWS texts are fitted on the driver."""
    train = checkpointed(training_rows(docs, labels))
    rows = sorted(train.select("id", "text", "toxic").collect(), key=lambda r: (r["id"], r["text"]))
    if len({r["toxic"] for r in rows}) < 2:
        return None
    by_text = copy_groups(train)
    groups = [by_text[_text_key(r["text"])] for r in rows]
    size = Counter(groups)
    field = Field({f: i for i, f in enumerate(frequent_features(train, by_text))})
    tokens = Tokens([r["text"].encode() for r in rows], field.look_up)
    field._known.clear()
    field.fit(tokens, np.array([r["toxic"] for r in rows]), np.array([1 / size[g] for g in groups]))
    return field


def _spans(text: bytes, marginals: np.ndarray, least: float = 0.5) -> list[tuple[int, int, float]]:
    """Code point offsets of runs of toxic tokens, with the highest marginal of each."""
    if not (marginals >= least).any():
        return []
    raw = np.frombuffer(text, dtype=np.uint8)
    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points before each byte
    out: list[list] = []
    last = -2
    for i, token in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", text)):
        if marginals[i] >= least:
            start, end = int(points[token.start()]), int(points[token.end()])
            if i == last + 1:
                out[-1][1:] = [end, max(out[-1][2], float(marginals[i]))]
            else:
                out.append([start, end, float(marginals[i])])
            last = i
    return [tuple(x) for x in out]


def score_documents(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3) -> DataFrame:
    """``(id, held_out, score, predicted, spans)`` of each row of ``docs``."""
    field = fit(docs, labels)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def score_piece(texts: list[bytes | None]) -> Iterator[tuple[float, list]]:
        if field is None:
            yield from ((0.0, []) for _ in texts)
            return
        tokens = Tokens(texts, field.look_up)
        found = field.run(tokens)
        scores = -np.expm1(-tokens.per_text(found.log_z))
        for text, score, at, n in zip(texts, scores.tolist(), tokens.words.starts.tolist(), tokens.words.counts.tolist()):
            yield score, _spans(text or b"", found.toxic[at : at + n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores, piece, held = batch.column("text").cast(pa.large_binary()), [], [], 0
            for n, text in enumerate(texts, 1):
                piece.append(text.as_py())
                held += len(piece[-1] or b"")
                if held >= PIECE_BYTES or n == len(texts):
                    scores += score_piece(piece)
                    piece, held = [], 0
            spans = [[dict(zip(("start", "end", "probability"), s)) for s in own] for _, own in scores]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array([s for s, _ in scores], pa.float64()), pa.array(spans, kind)], ["id", "held_out", "score", "spans"])

    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), (remainder == fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(run, "id long, held_out boolean, score double, spans array<struct<start:int,end:int,probability:double>>")
    return scored.select("id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
