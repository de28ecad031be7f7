"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words, all of them, however many. Each passage is encoded by
shares of character classes, word statistics and a signed hash of its words, all computed by numpy over the
UTF-8 bytes. Gated attention (tanh and sigmoid gates) weighs the passages; the weighted passage representation
gives the document's score. Weights are learnt from document labels alone.

Training takes at most SAMPLE labelled documents of at most SAMPLE_BYTES bytes each, those with the least hash of their id
outside the held-out fold; that is the only bounded sample, and scoring covers all texts whole. Labels, language,
source and id are never inputs of a score.

Defined results: a null or empty text is a bag of one empty passage; texts without labels are scored like others; without
any usable label all scores are 1/2; several labels of one id count as their largest; a null label doesn't count; repeated
rows each get their own row, with equal scores; an empty table gives no rows; extra columns are ignored, and accepted()
keeps them as they are; long texts are encoded piece by piece, cut at passages, and their features take about as much memory
as the text; of sampled documents with equal hashes the least ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SUB_BYTES, clear_name, fold_of, give_back, ready, sub_batches, text_or_empty, tidied
from .shingles import joined, pieces, words_in

PASSAGE_WORDS = 80
HASHED = 64
HIDDEN = 32
SAMPLE, SAMPLE_BYTES = 4000, 60_000
EPOCHS = 15
#: Texts of more bytes are encoded piece by piece.
LONG = 2 * SUB_BYTES - 1
FOLDS = 5

#: Byte classes whose shares are features.
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "symbol", "other", "high")


def _classes() -> np.ndarray:
    out = np.full(256, CLASSES.index("other"), np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = (CLASSES.index(c) for c in ("lower", "upper", "digit", "high"))
    out[[32, 9, 11, 12, 13]], out[10] = CLASSES.index("blank"), CLASSES.index("newline")
    out[[ord(c) for c in ".,;:?!"]] = CLASSES.index("stop")
    out[[ord(c) for c in "#*$%&|<>@{}[]\\^~_=+/"]] = CLASSES.index("symbol")
    return out


CLASS_OF = _classes().astype(np.int32)
FEATURES = len(CLASSES) + 9 + HASHED


def encode(texts: list[bytes], ended: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (at least one). A passage's bytes go up to
    the next passage's first word. ended: not for a piece of one text after which more comes, which ends with white space."""
    data, stops = joined(texts) if ended else (np.frombuffer(texts[0], np.uint8), np.array([len(texts[0])]))
    all_words, starts, ends = words_in(data)
    upto = np.searchsorted(starts, stops)
    n_words = np.diff(upto, prepend=0)
    n_bags = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.cumsum(n_bags) - n_bags
    total = int(n_bags.sum())
    bag_doc = np.repeat(np.arange(len(texts)), n_bags)
    inner = np.arange(total) - first[bag_doc]
    begins = np.concatenate([[0], stops[:-1]])[bag_doc]
    begins[inner > 0] = starts[((upto - n_words)[bag_doc] + inner * PASSAGE_WORDS)[inner > 0]]
    bag = np.repeat(np.arange(total, dtype=np.int32), np.diff(begins, append=len(data)))
    shares = np.bincount(bag * np.int32(len(CLASSES)) + CLASS_OF[data], minlength=total * len(CLASSES)).reshape(total, -1).astype(np.float64)
    n_bytes = np.maximum(shares.sum(axis=1, keepdims=True), 1)
    out = np.zeros((total, FEATURES))
    out[:, : len(CLASSES)] = shares / n_bytes

    in_bag = np.minimum(PASSAGE_WORDS, n_words[bag_doc] - inner * PASSAGE_WORDS)
    w_bag = np.repeat(np.arange(total), in_bag)
    count = np.maximum(in_bag, 1)
    lengths = (ends - starts).astype(np.float64)
    sums = lambda x: np.bincount(w_bag, x, total) / count
    mean = sums(lengths)
    upper_first = (data[starts] >= 65) & (data[starts] <= 90)
    # 44 bits of each word's number under its passage
    keys = np.sort(w_bag.astype(np.uint64) << np.uint64(44) | all_words >> np.uint64(20))
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    key_bag = (keys[edges] >> np.uint64(44)).astype(np.int64)
    same = np.zeros(len(all_words))
    same[1:] = (all_words[1:] == all_words[:-1]) & (w_bag[1:] == w_bag[:-1])
    top = np.zeros(total)
    np.maximum.at(top, key_bag, np.diff(edges, append=len(keys)))
    high_share = shares[:, CLASSES.index("high")] / n_bytes[:, 0]
    letters = shares[:, :2].sum(axis=1)
    extra = (mean / 10, np.sqrt(np.maximum(sums(lengths**2) - mean**2, 0)) / 5, sums(upper_first.astype(np.float64)), np.bincount(key_bag, minlength=total) / count, sums(same), top / count, np.log1p(in_bag) / 5, shares[:, 1] / np.maximum(letters, 1), high_share**0.5)
    for i, x in enumerate(extra):
        out[:, len(CLASSES) + i] = x
    bucket = (all_words % np.uint64(HASHED)).astype(np.int64)
    sign = np.where(all_words >> np.uint64(63), 1.0, -1.0)
    hashed = np.bincount(w_bag * HASHED + bucket, sign, total * HASHED).reshape(total, HASHED)
    out[:, len(CLASSES) + 9 :] = hashed / np.maximum(np.linalg.norm(hashed, axis=1, keepdims=True), 1)
    return out, n_bags


def whole_passages(text: bytes, most: int = LONG):
    """Pieces of a long text, cut before the first word of a passage, and whether a piece is the last."""
    rest = b""
    for piece in pieces(text, most):
        rest += piece
        _, starts, _ = words_in(np.frombuffer(rest + b"\n", np.uint8))
        if (k := (len(starts) - 1) // PASSAGE_WORDS * PASSAGE_WORDS) > 0:
            yield rest[: starts[k]], False
            rest = rest[starts[k] :]
    yield rest, True


def encoded(texts: list[bytes]):
    """(features, passages of each text) of some texts after others, all of them; long ones piece by piece."""
    for a, b in sub_batches(texts):
        if b == a + 1 and len(texts[a]) > LONG:
            x = np.concatenate([encode([p], last)[0] for p, last in whole_passages(texts[a])])
            yield x, np.array([len(x)])
        else:
            yield encode(texts[a:b])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Encoder (W, b), gates (V, U), attention w, and the classifier (c, d) over scaled features."""

    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, n_bags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        s = (x - p["mean"]) / p["spread"]
        e = np.tanh(s @ p["W"] + p["b"])
        t, g = np.tanh(e @ p["V"]), _sigmoid(e @ p["U"])
        raw = (t * g) @ p["w"]
        starts = np.cumsum(n_bags) - n_bags
        doc = np.repeat(np.arange(len(n_bags)), n_bags)
        power = np.exp(raw - np.maximum.reduceat(raw, starts)[doc])
        a = power / np.add.reduceat(power, starts)[doc]
        z = np.add.reduceat(a[:, None] * e, starts)
        return {"s": s, "e": e, "t": t, "g": g, "a": a, "z": z, "doc": doc, "starts": starts, "y": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, x: np.ndarray, n_bags: np.ndarray) -> np.ndarray:
        return self.forward(x, n_bags)["y"]

    def gradients(self, f: dict[str, np.ndarray], label: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(label)
        dy = (f["y"] - label) / n
        out = {"c": f["z"].T @ dy, "d": np.array([dy.sum()])}
        dz = dy[:, None] * p["c"][None, :]
        da = (dz[f["doc"]] * f["e"]).sum(axis=1)
        de = f["a"][:, None] * dz[f["doc"]]
        draw = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[f["doc"]])
        out["w"] = (f["t"] * f["g"]).T @ draw
        dt = draw[:, None] * p["w"][None, :] * f["g"] * (1 - f["t"] ** 2)
        dg = draw[:, None] * p["w"][None, :] * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["e"].T @ dt, f["e"].T @ dg
        de = de + dt @ p["V"].T + dg @ p["U"].T
        ds = de * (1 - f["e"] ** 2)
        out["W"], out["b"] = f["s"].T @ ds, ds.sum(axis=0)
        return out


def learn(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, decay: float = 1e-4) -> Model:
    """Adam over mini-batches of documents; the same bags give the same model."""
    rng = np.random.default_rng(seed)
    n = sum(map(len, bags))
    mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / n
    spread = np.sqrt(sum(((b - mean) ** 2).sum(axis=0) for b in bags) / n) + 1e-3
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, HIDDEN), "U": init(HIDDEN, HIDDEN), "w": init(HIDDEN), "c": init(HIDDEN), "d": np.zeros(1)}
    model = Model(p | {"mean": mean, "spread": spread})
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = 0.005 * (1 - epoch / epochs) + 1e-4
        for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 128)):
            x = np.concatenate([bags[i] for i in part]).astype(np.float64)
            f = model.forward(x, np.array([len(bags[i]) for i in part]))
            step += 1
            for k, grad in model.gradients(f, labels[part]).items():
                grad = grad + decay * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


@tidied
def _bags(batches):
    for batch in batches:
        raw = [(t or "").encode("utf-8") for t in batch.column(2).to_pylist()]
        rows = [part.astype(np.float32).tobytes() for x, n in encoded(raw) for part in np.split(x, np.cumsum(n)[:-1])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "bag"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, folds: int = FOLDS) -> Model | None:
    """The model of the labelled documents outside fold 0, or None without two kinds of labels."""
    ready(docs.sparkSession)
    key = F.col(id_col).cast("long")
    known = labels.where(F.col(label_col).isNotNull() & key.isNotNull() & (fold_of(id_col, folds) != 0)).groupBy(key.alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    small = docs.where(F.octet_length(text_or_empty(text_col)) <= sample_bytes).select(key.alias("_id"))
    picked = known.join(small, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = docs.select(key.alias("_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length(text_or_empty("text")) <= sample_bytes).join(F.broadcast(picked), "_id")
    rows = chosen.select("_id", "label", "text").mapInArrow(_bags, "doc_id long, label int, bag binary").toPandas().sort_values("doc_id")
    if rows.label.nunique() < 2:
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in rows.bag]
    return learn(bags, (rows.label.to_numpy() > 0).astype(np.float64))


def with_scores(docs: DataFrame, model: Model | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs and the score of every whole text."""
    if model is None:
        return docs.withColumn(score_col, F.lit(0.5))
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = [sent.value.score(*x) for x in encoded([(t or "").encode("utf-8") for t in texts])]
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)
        give_back()

    return docs.withColumn(score_col, scored(text_or_empty(text_col)))


def accepted(docs: DataFrame, model: Model | None, *, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, whose texts score at least so much."""
    name = clear_name(docs, "_score")
    return with_scores(docs, model, text_col=text_col, score_col=name).where(F.col(name) >= least).drop(name)


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = train(docs, labels, id_col=id_col, **options)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(options.get("text_col", "text")).alias("text"))
    out = with_scores(slim, model)
    return out.select("doc_id", (fold_of("doc_id", options.get("folds", FOLDS)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
