"""Toxic spans by a linear-chain conditional random field, trained on documents with labels.

Token labels. Documents are labelled, tokens are not, so tokens are labelled from them: a feature (a word or
a word's prefix) whose distinct occurrences stand far more often in toxic documents marks toxic tokens; all
tokens of clean documents are clean. Occurrences are counted once per preceding word, so that copies of one
toxic document don't turn its other words into marks.

Model. Sequences are sentences (cut at ``.``, ``!``, ``?`` and line ends, and at ``LONGEST`` words). Two
states; weights per mark and for the marks of both neighbours, a bias, and transitions; trained by gradient on the
forward-backward marginals. Sentences without a mark all get the same marginals for their length, which are
looked up. A document's score is a logistic function of the expected number of toxic tokens, their density
and the largest marginal; spans are runs of tokens with a marginal of at least one half.

The training sample holds at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents, the first by a hash of
their ids, and of each class no more than ``MAX_BYTES`` of text (one longer text stands alone); whole texts are
used. Scoring covers every whole text of every row.

Defined results: null and empty texts have no tokens and the score of an expected count of zero; repeated
rows are scored each; null ids are scored and never train; a document with several labels counts as toxic if
any is, and so does a text that several ids share; of rows that share an id the least text trains; without
labelled toxic and clean documents every score is the share of toxic ones (0 if none); an empty table gives an
empty result; other columns, also such that differ from the two in case only, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from vouchline.llm.common import LOWER, distinct_spans, doc_chunks, pick, splitmix, table, text_bytes, word_ids

MAX_TOXIC, MAX_CLEAN = 1200, 1800
MAX_BYTES = 12_000_000
PREFIXES = (4, 5, 6, 7)
#: A mark occurs at least so often, and so many times as often in toxic documents.
LEAST, RATIO = 3, 12.0
LONGEST = 64
_CHUNK = 3_000_000
_STEPS = 80

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 63]] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case (the latter are C3 80 to C3 9E, without C3 97)."""
    out = LOWER[buf]
    if len(out) > 1:
        tail = out[1:]
        tail[(buf[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    return out


class Tokens:
    """Word spans of documents laid end to end, their sentences and feature hashes (whole word, then prefixes)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = _WORD[buf]
        begin = inside[1:-1] & ~inside[:-2]
        firsts = off[:-1][off[:-1] < len(buf)]
        begin[firsts] = inside[1:-1][firsts]
        finish = inside[1:-1] & ~inside[2:]
        lasts = off[1:][off[1:] > 0] - 1
        finish[lasts] = inside[1:-1][lasts]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.bounds = np.searchsorted(self.start, off)
        n = len(self.start)
        stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
        new = np.ones(n, bool)
        new[1:] = stops[self.start[1:]] != stops[self.start[:-1]]
        new[self.bounds[:-1][self.bounds[:-1] < n]] = True
        head = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
        new |= place % LONGEST == 0
        self.head = np.flatnonzero(new)
        self.size = np.diff(np.append(self.head, n))
        codes, words = distinct_spans(lowered(buf), self.start, self.end)
        self.features = [word_ids(words)[codes]]
        for k in PREFIXES:  # shorter words have no such prefix
            self.features.append(np.fromiter((xxh3_64_intdigest(w[:k], k) | 1 if len(w) >= k else 0 for w in words), np.uint64, len(words))[codes])

    @classmethod
    def of(cls, texts: list[bytes], part: int = 1_000_000) -> Tokens:
        """Tokens of many texts, hashed some at a time: what hashing needs grows with a part, not with all texts."""
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        parts = [cls(np.frombuffer(b"".join(texts[i:j]), np.uint8), off[i : j + 1] - off[i]) for i, j in doc_chunks(off, part)]
        out = cls.__new__(cls)
        n = np.cumsum([0] + [len(p.start) for p in parts])
        out.start = out.end = np.zeros(n[-1], np.int8)  # places aren't needed for training
        out.bounds = np.concatenate([[0], *(p.bounds[1:] + k for p, k in zip(parts, n, strict=False))])
        out.head = np.concatenate([p.head + k for p, k in zip(parts, n, strict=False)])
        out.size = np.concatenate([p.size for p in parts])
        out.features = [np.concatenate([p.features[f] for p in parts]) for f in range(len(PREFIXES) + 1)]
        return out


def _distinct(tokens: Tokens, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Features with the number of their occurrences after distinct words, over the chosen tokens; and of all."""
    before = np.concatenate([[np.uint64(7)], tokens.features[0][:-1]])[chosen]
    seen = []
    for f in tokens.features:  # words and prefixes of different lengths have different hashes
        feature = f[chosen]
        seen.append(np.unique(feature[np.unique(splitmix(feature) ^ before, return_index=True)[1]], return_counts=True))
    values, counts = np.concatenate([v for v, _ in seen]), np.concatenate([c for _, c in seen])
    order = np.argsort(values, kind="stable")
    return values[order], counts[order], max(1, int(np.unique(splitmix(tokens.features[0][chosen]) ^ before).size))


def marks(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features that mark toxic tokens. toxic: per token, whether its document is."""
    ones, n1, all1 = _distinct(tokens, toxic)
    zeros, n0, all0 = _distinct(tokens, ~toxic)
    at = np.searchsorted(zeros, ones).clip(max=max(0, len(zeros) - 1))  # hash 0 repeats, and is no feature
    clean = np.where(zeros[at] == ones, n0[at], 0) if len(zeros) else np.zeros(len(ones))
    found = (n1 >= LEAST) & ((n1 + 0.5) / all1 >= RATIO * (clean + 0.5) / all0) & (ones != 0)
    return ones[found]


def active(tokens: Tokens, lexicon: np.ndarray) -> np.ndarray:
    """(features, tokens): the number of the mark, or len(lexicon) where there is none."""
    out = np.full((len(tokens.features), len(tokens.start)), len(lexicon), np.int32)
    if len(lexicon):
        for k, f in enumerate(tokens.features):
            at = np.searchsorted(lexicon, f).clip(max=len(lexicon) - 1)
            out[k] = np.where(lexicon[at] == f, at, len(lexicon))
    return out


def forward_backward(emit: np.ndarray, size: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of two-state chains: emit (chains, steps) is the score of state 1, 0 being that of state 0.

    Returns P(state 1) per step, expected transitions (2, 2) over all chains (each as often as its weight), and each chain's log normaliser.
    """
    n, steps = emit.shape
    times = np.ones(n) if weight is None else weight
    alpha = np.full((n, steps, 2), 0.0)
    alpha[:, 0, 1] = emit[:, 0]
    for t in range(1, steps):
        live = size > t
        a = alpha[live, t - 1]
        alpha[live, t, 0] = np.logaddexp(a[:, 0] + trans[0, 0], a[:, 1] + trans[1, 0])
        alpha[live, t, 1] = np.logaddexp(a[:, 0] + trans[0, 1], a[:, 1] + trans[1, 1]) + emit[live, t]
    last = alpha[np.arange(n), size - 1]
    log_z = np.logaddexp(last[:, 0], last[:, 1])
    beta = np.zeros((n, steps, 2))
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        live = size > t + 1
        b, e = beta[live, t + 1], emit[live, t + 1]
        for i in (0, 1):
            beta[live, t, i] = np.logaddexp(trans[i, 0] + b[:, 0], trans[i, 1] + e + b[:, 1])
            pairs[i, 0] += np.exp(alpha[live, t, i] + trans[i, 0] + b[:, 0] - log_z[live]) @ times[live]
            pairs[i, 1] += np.exp(alpha[live, t, i] + trans[i, 1] + e + b[:, 1] - log_z[live]) @ times[live]
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None])
    p[np.arange(steps)[None, :] >= size[:, None]] = 0
    return p, pairs, log_z


class Crf:
    """weights: per mark, own and neighbours'; the last entry (no mark) stays 0."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon
        self.own, self.near = np.zeros(len(lexicon) + 1), np.zeros(len(lexicon) + 1)
        self.bias, self.trans = -3.0, np.zeros((2, 2))

    def emissions(self, act: np.ndarray, head: np.ndarray) -> np.ndarray:
        own, near = self.own[act].sum(0), self.near[act].sum(0)
        out = own + self.bias
        first = np.zeros(len(own), bool)
        first[head] = True
        left = np.append(0.0, near[:-1])
        left[first] = 0
        right = np.append(near[1:], 0.0)
        right[np.append(first[1:], True)] = 0
        return out + left + right

    def marginals(self, tokens: Tokens, act: np.ndarray) -> np.ndarray:
        """P(toxic) of each token; only chains with a mark are run, the others' depends on their length alone."""
        n = len(tokens.start)
        out = np.zeros(n)
        if not n:
            return out
        plain = getattr(self, "_plain", None)
        if plain is None:
            grid = np.full((LONGEST, LONGEST), self.bias)
            self._plain = plain = forward_backward(grid, np.arange(1, LONGEST + 1), self.trans)[0]
        chain = np.repeat(np.arange(len(tokens.head)), tokens.size)
        place = np.arange(n) - tokens.head[chain]
        out[:] = plain[tokens.size[chain] - 1, place]
        hot = np.unique(chain[(act < len(self.lexicon)).any(0)])
        if len(hot):
            emit = self.emissions(act, tokens.head)
            for k in range(0, len(hot), 4096):
                rows = hot[k : k + 4096]
                grid, index = _grid(emit, tokens.head[rows], tokens.size[rows])
                p = forward_backward(grid, tokens.size[rows], self.trans)[0]
                out[index[index >= 0]] = p[index >= 0]
        return out

    def fit(self, tokens: Tokens, act: np.ndarray, labels: np.ndarray, rate: float = 0.15, decay: float = 1e-3) -> None:
        """Adam on the log likelihood; chains without a mark enter by their number of each length."""
        chain = np.repeat(np.arange(len(tokens.head)), tokens.size)
        marked = np.zeros(len(tokens.head), bool)
        marked[np.unique(chain[(act < len(self.lexicon)).any(0)])] = True
        rows = np.flatnonzero(marked)
        lengths = np.bincount(tokens.size[~marked], minlength=LONGEST + 1)
        some = np.flatnonzero(lengths)
        _, index = _grid(np.zeros(len(chain)), tokens.head[rows], tokens.size[rows])
        y = np.where(index >= 0, labels[index], 0)
        inside = index >= 0
        observed = np.zeros((2, 2))
        if len(rows):
            pair = inside[:, 1:]
            for i in (0, 1):
                for j in (0, 1):
                    observed[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & pair).sum()
        observed[0, 0] += (lengths[some] * (some - 1)).sum()
        flat, order = index[inside], tokens
        total = max(1, len(chain))
        params = np.concatenate([self.own[:-1], self.near[:-1], [self.bias], self.trans.ravel()])
        m, v, k = np.zeros_like(params), np.zeros_like(params), len(self.lexicon)
        for step in range(1, _STEPS + 1):
            self.own[:-1], self.near[:-1], self.bias, self.trans = params[:k], params[k : 2 * k], params[2 * k], params[2 * k + 1 :].reshape(2, 2)
            grad = np.zeros_like(params)
            expected = np.zeros((2, 2))
            if len(rows):
                grid, _ = _grid(self.emissions(act, tokens.head), order.head[rows], order.size[rows])
                p, pairs, _ = forward_backward(grid, tokens.size[rows], self.trans)
                expected += pairs
                miss = np.zeros(len(chain))
                miss[flat] = (y - p)[inside]
                first = np.zeros(len(chain), bool)
                first[tokens.head] = True
                left = np.append(miss[1:], 0.0)
                left[np.append(first[1:], True)] = 0
                right = np.append(0.0, miss[:-1])
                right[first] = 0
                for a in act:
                    grad[:k] += np.bincount(a, miss, k + 1)[:k]
                    grad[k : 2 * k] += np.bincount(a, left + right, k + 1)[:k]
                grad[2 * k] += miss.sum()
            if len(some):
                # one chain of each length, weighted by how many there are
                many = lengths[some].astype(float)
                p, pairs, _ = forward_backward(np.full((len(some), int(some[-1])), self.bias), some, self.trans, many)
                expected += pairs
                grad[2 * k] -= many @ p.sum(1)
            grad[2 * k + 1 :] += (observed - expected).ravel()
            grad = grad / total ** 0.5 - decay * params
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.own[:-1], self.near[:-1], self.bias, self.trans = params[:k], params[k : 2 * k], params[2 * k], params[2 * k + 1 :].reshape(2, 2)


def _grid(values: np.ndarray, head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains as rows, padded; and the token of each place (-1 beyond a chain's end)."""
    steps = int(size.max()) if len(size) else 1
    index = head[:, None] + np.arange(steps)[None, :]
    inside = np.arange(steps)[None, :] < size[:, None]
    return np.where(inside, values[np.where(inside, index, 0)], 0.0), np.where(inside, index, -1)


def document_inputs(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: 1, log expected toxic tokens, log density, largest marginal."""
    n = np.diff(bounds)
    total = np.concatenate([[0.0], np.cumsum(p)])
    expected = np.maximum(total[bounds[1:]] - total[bounds[:-1]], 0)
    top = np.zeros(len(n))
    if len(p):
        some = n > 0
        top[some] = np.maximum.reduceat(p, bounds[:-1][some])
    return np.stack([np.ones(len(n)), np.log(expected + 0.05), np.log(expected / np.maximum(n, 1) + 1e-4), top], 1)


class Model:
    def __init__(self, crf: Crf | None, weights: np.ndarray, center: np.ndarray):
        self.crf, self.weights, self.center = crf, weights, center

    def scores(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Score of each document, marginal of each token."""
        p = self.crf.marginals(tokens, active(tokens, self.crf.lexicon)) if self.crf else np.zeros(len(tokens.start))
        return 1 / (1 + np.exp(-((document_inputs(p, tokens.bounds) - self.center) @ self.weights).clip(-40, 40))), p


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < share < 1:
        return Model(None, np.array([40.0 if share else -40.0, 0, 0, 0]), np.zeros(4))
    tokens = Tokens.of(texts)
    of_token = np.repeat(toxic.astype(bool), np.diff(tokens.bounds))
    crf = Crf(marks(tokens, of_token))
    act = active(tokens, crf.lexicon)
    crf.fit(tokens, act, (of_token & (act < len(crf.lexicon)).any(0)).astype(np.int64))
    x = document_inputs(crf.marginals(tokens, act), tokens.bounds)
    center = x.mean(0)
    center[0] = 0
    x = x - center
    w = np.zeros(4)
    for _ in range(50):  # Newton steps of a logistic regression with a ridge
        q = 1 / (1 + np.exp(-(x @ w).clip(-40, 40)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(4), x.T @ (toxic - q) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(crf, w, center)


def train(docs: DataFrame, labels: DataFrame, trains: str, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on labelled rows where ``trains`` (SQL over the id) holds, at most MAX_TOXIC + MAX_CLEAN of them."""
    known = pick(labels, "doc_id", "toxic").toDF(id_col, "__toxic").where(f"{id_col} IS NOT NULL AND __toxic IS NOT NULL AND ({trains})").groupBy(id_col).agg(F.max("__toxic").alias("__toxic"))
    texts = pick(docs, id_col, text_col).where(F.col(text_col).isNotNull())
    # labels without a text don't use up the bound: only ids that occur are drawn from
    known = known.join(texts.select(id_col).distinct(), id_col, "left_semi")
    toxic, clean = known.agg(F.count_if(F.col("__toxic") > 0), F.count_if(F.col("__toxic") <= 0)).first()
    drawn = [known.where(f"__toxic {test}").orderBy(F.xxhash64(id_col), id_col).limit(most) for test, most in (("> 0", MAX_TOXIC), ("<= 0", MAX_CLEAN))]
    sample = drawn[0].unionByName(drawn[1])
    one = texts.join(F.broadcast(sample), id_col).groupBy(id_col).agg(F.min(text_col).alias("t"), F.max("__toxic").alias("y"))
    by_hash = Window.partitionBy(F.col("y") > 0).orderBy(F.xxhash64(id_col), id_col)  # at most MAX_TOXIC + MAX_CLEAN rows
    held = one.withColumn("b", F.sum(F.octet_length("t")).over(by_hash)).withColumn("k", F.row_number().over(by_hash)).where(F.expr(f"b <= {MAX_BYTES} OR k = 1"))
    rows: dict[str, int] = {}
    for r in held.select("t", "y", id_col).orderBy(id_col, "t").toLocalIterator():
        rows[r[0]] = max(rows.get(r[0], 0), int(r[1] > 0))  # equal texts once
    model = fit([t.encode() for t in rows], np.array(list(rows.values()), float))
    # the classes are drawn at different rates: the odds of all labelled rows are the sample's over the rates' ratio
    model.weights[0] -= np.log(min(1.0, MAX_TOXIC / max(toxic, 1)) / min(1.0, MAX_CLEAN / max(clean, 1)))
    return model


def tag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted, spans (array of struct(start, end, marginal), code points, end exclusive)."""
    docs = pick(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def rows(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            for i, j in doc_chunks(off, _CHUNK):
                part, at = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                tokens = Tokens(part, at)
                score, p = shared.value.scores(tokens)
                spans = [[] for _ in range(j - i)]
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                    doc = np.searchsorted(tokens.bounds, hit, "right") - 1
                    cut = np.flatnonzero(np.append(True, (np.diff(hit) > 1) | (np.diff(doc) > 0)))
                    for a, b in zip(cut.tolist(), np.append(cut[1:], len(hit)).tolist(), strict=True):
                        d, zero = doc[a], chars[at[doc[a]]]
                        spans[d].append({"start": int(chars[tokens.start[hit[a]]] - zero), "end": int(chars[tokens.end[hit[b - 1]]] - zero), "marginal": float(p[hit[a:b]].max())})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])))],
                    names=[id_col, "score", "predicted", "spans"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(rows, f"`{id_col}` {kind}, score double, predicted int, spans array<struct<start:bigint,end:bigint,marginal:double>>")


_HELD = "crc32(CAST(coalesce(CAST(doc_id AS string), '') AS binary)) % 5 = 0"


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, spans over all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), f"NOT ({_HELD})")
    return tag(docs, model).select("doc_id", F.expr(_HELD).alias("held_out"), "score", "predicted", "spans")
