"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Labelled rows are split by a hash of the text into three folds. On the first, voters are chosen - a small fixed lexicon
and patterns found there, words and word beginnings that occur mostly in toxic rows - and their accuracies estimated.
The label model is a two-class latent model of the votes of all rows: EM starts from those accuracies, which stay as
prior counts of three times those rows, and estimates how often each voter votes given each class and how voters are correlated within a class; a
voter's evidence is divided by the correlated votes it comes with, so copies of one signal count once (their sum, but no
less than the strongest of them alone). Its posteriors
come from votes alone, no label is mixed in. A logistic classifier over words and word beginnings is trained on the
posteriors of the rows outside the last fold. That fold's labels set the scale and shift of its scores, and nothing else.

Fitting uses at most max_labelled rows, those with the smallest hash among rows that may be learned from; they become
sets of distinct words where they are read, and one task fits on the sets. Scoring reads every whole text once, without
a shuffle; the model has at most max_features weights.

Nulls and empty texts have no features and get the score of the bias. Repeated rows score alike; for the fit they count
once. Ties between features are broken by their names. Very long texts count as the set of their words. Without labels
of both classes in a fold the lexicon alone votes. Empty tables give empty results. Language, source and ids are never
inputs, and other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: English insults that vote toxic before anything is learned.
LEXICON = ("clown", "disgusting", "dumb", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless")
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)


def features(text: str | None) -> set[str]:
    """Distinct words of a text, and beginnings of its longer words marked by ^."""
    found = set(_WORD.findall((text or "").lower()))
    for k in PREFIXES:
        found |= {"^" + w[:k] for w in found if len(w) > k and w[0] != "^"}
    return found


def label_model(votes: np.ndarray, rates: np.ndarray, share: float, strength: float, rounds: int = 12, silent: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the toxic class for rows x voters of 0/1 votes; and the voters' rates by class and correlation discounts.

    rates: (2, voters) accuracies to start from, which count as `strength` rows; share: of toxic rows, alike. A voter that
    doesn't vote abstains, as no voter is expected to see all of a class; a row without votes is toxic with probability
    silent.
    """
    prior, discount = np.clip(rates, 1e-4, 1 - 1e-4), np.ones(votes.shape[1])
    rates = prior.copy()
    counts = strength * np.array([1 - share, share])
    for step in range(rounds):
        on = np.log(rates[1] / rates[0])
        both = np.maximum(votes @ (on / discount), (votes * np.maximum(on, 0)).max(1, initial=0))
        post = 1 / (1 + np.exp(-np.clip(np.log(silent / (1 - silent)) + both, -30, 30)))
        for c, weight in enumerate((1 - post, post)):
            rates[c] = (weight @ votes + counts[c] * prior[c]) / (weight.sum() + counts[c])
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        if step in (2, 6):
            discount = np.ones(votes.shape[1])
            for weight in (1 - post, post):  # correlation left within a class
                total = max(weight.sum(), 1.0)
                mean = weight @ votes / total
                cov = (votes * weight[:, None]).T @ votes / total - np.outer(mean, mean)
                sd = np.sqrt(np.clip(np.diag(cov), 1e-6, None))
                corr = np.clip(cov / np.outer(sd, sd), 0, 1)
                np.fill_diagonal(corr, 0)
                discount = np.maximum(discount, 1 + np.where(corr > 0.2, corr, 0).sum(1))
    return post, rates, discount


def _logistic(rows: list[np.ndarray], width: int, target: np.ndarray, steps: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on sparse binary rows with soft targets (full-batch Adagrad)."""
    index = np.concatenate([np.zeros(0, np.int64), *rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(width), float(np.log(target.mean() / (1 - target.mean())))
    gw, gb = np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(owner, w[index], len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g = np.bincount(index, error[owner], width) + l2 * w
        gw, gb = gw + g * g, gb + error.sum() ** 2
        w, b = w - 0.5 * g / np.sqrt(gw), b - 0.2 * error.sum() / np.sqrt(gb)
    return w, b


#: Folds of the labelled rows: voters and their accuracies, label model only, calibration.
FOLDS = 10
VOTERS_UPTO, DEV_FROM = 6, 8


def _clear(sets: list[set], toxic: np.ndarray) -> dict[str, tuple[float, int, int]]:
    """Feature -> its surprise, and the toxic and other rows that have it, where chance would hardly give such a split anywhere among all features."""
    count: dict[str, list[int]] = {}
    for s, y in zip(sets, toxic.tolist(), strict=True):
        for f in s:
            count.setdefault(f, [0, 0])[y] += 1
    share = toxic.mean()
    chance = np.log(len(count) + 1) + 2

    def surprise(p: int, n: int) -> float:
        return float(sum(k * np.log(k / ((p + n) * q)) for k, q in ((p, share), (n, 1 - share)) if k))

    return {f: (u, p, n) for f, (n, p) in count.items() if (u := surprise(p, n)) > chance}


def _voters(clear: dict, sets: list[set], toxic: np.ndarray, limit: int) -> list[str]:
    """The lexicon and the features that occur mostly in toxic rows, the clearest first, without repeats of one signal (a word and its beginning)."""
    share = toxic.mean()
    strong = sorted((f for f, (_, p, n) in clear.items() if p >= 3 * n and p > share * (p + n)), key=lambda f: (-clear[f][0], f))
    bad = [s for s, y in zip(sets, toxic.tolist(), strict=True) if y]
    mark = lambda f: np.array([f in s for s in bad])
    voters, held = list(LEXICON), [mark(f) for f in LEXICON]
    for f in strong:
        mine = mark(f)
        if f not in LEXICON and len(voters) < limit and not any((mine & other).sum() > 0.6 * mine.sum() for other in held):
            voters.append(f)
            held.append(mine)
    return voters


def fit(sets: list[set], toxic: np.ndarray, folds: np.ndarray, max_features: int = 4096, max_voters: int = 256) -> dict[str, float]:
    """Feature weights; "" holds the bias. sets: features of each row; folds: 0 to FOLDS - 1."""
    plain = {w: 4.0 for w in LEXICON} | {"": -3.0}
    first, dev = folds < VOTERS_UPTO, folds >= DEV_FROM
    if not all(0 < toxic[x].sum() < x.sum() for x in (first, dev)):
        return plain
    pick = lambda mask: [s for s, m in zip(sets, mask.tolist(), strict=True) if m]
    clear = _clear(pick(first), toxic[first])
    voters = _voters(clear, pick(first), toxic[first], max_voters)
    fitting = pick(~dev)
    votes = lambda rows: np.array([[f in s for f in voters] for s in rows], np.float32)
    seen, y = votes(pick(first)), toxic[first]
    # a little of the other class for each, less for the class that is rare
    rates = np.stack([(seen[y == c].sum(0) + extra) / ((y == c).sum() + 1) for c, extra in ((0, 0.02), (1, 0.2))])
    post, _, _ = label_model(votes(fitting), rates, float(y.mean()), 3.0 * len(y))
    names = list(dict.fromkeys([*voters, *sorted(clear, key=lambda f: (-clear[f][0], f))]))[:max_features]
    place = {f: i for i, f in enumerate(names)}
    index = lambda rows: [np.array(sorted(place[f] for f in s if f in place), np.int64) for s in rows]
    w, b = _logistic(index(fitting), len(names), np.clip(post, 0.005, 0.995))
    # scale and shift on the last fold's labels, by damped Newton steps; the prior row of either class keeps them finite
    z = np.array([w[r].sum() for r in index(pick(dev))] + [float(np.abs(w).max()), -float(np.abs(w).max())]) + b
    target = np.concatenate((toxic[dev], [1, 0]))
    a, c = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        e, v = p - np.clip(target, 0.002, 0.998), np.clip(p * (1 - p), 1e-6, None)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(e * z).sum(), e.sum()])
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
    return {f: float(a * x) for f, x in zip(names, w, strict=True)} | {"": float(a * b + c)}


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> dict[str, float]:
    """docs(doc_id, text), labels(doc_id, toxic) -> feature weights, fitted in one task on at most max_labelled rows."""
    ids = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = ids.withColumn("_o", F.xxhash64("doc_id", F.lit("toxicity"))).orderBy("_o", "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.xxhash64("text").alias("h"), "text", "toxic")

    def read(batches):
        import pyarrow as pa

        for b in batches:
            words = [sorted(features(t)) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("h"), b.column("toxic").cast(pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["h", "toxic", "words"])

    def work(batches):
        import pyarrow as pa

        got: dict = {}
        for b in batches:  # one row for each text: repeated rows count once
            for h, y, w in zip(*(b.column(c).to_pylist() for c in ("h", "toxic", "words")), strict=True):
                got[h] = max(got.get(h, (0, w)), (int(y > 0), w))
        keys = sorted(got)
        model = fit([set(got[k][1]) for k in keys], np.array([got[k][0] for k in keys], np.int64), np.array([k % FOLDS for k in keys], np.int64))
        yield pa.record_batch([pa.array(list(model), pa.string()), pa.array(list(model.values()), pa.float64())], names=["feature", "weight"])

    sets = rows.mapInArrow(read, "h long, toxic int, words array<string>")
    found = sets.repartition(1).mapInArrow(work, "feature string, weight double").collect()  # at most max_features rows
    return {r["feature"]: r["weight"] for r in found} or fit([], np.zeros(0, np.int64), np.zeros(0, np.int64))


def scored(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, score."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batches):
        import pyarrow as pa

        w = model.value
        bias = w.get("", 0.0)
        known = {f for f in w if f and f[0] != "^"}
        starts = {k: {f[1:] for f in w if f[:1] == "^" and len(f) == k + 1} for k in PREFIXES}
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                z = bias
                if text:
                    words = set(_WORD.findall(text.lower()))
                    z += sum(map(w.__getitem__, words & known))
                    for k, group in starts.items():
                        if group:
                            z += sum(w["^" + p] for p in {x[:k] for x in words if len(x) > k} & group)
                out.append(z)
            score = 1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30)))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "held_out", "text").mapInArrow(work, f"doc_id {kind}, held_out boolean, score double")


def op6_weak_toxicity(spark, sf_dir: str) -> DataFrame:
    remainder = F.pmod(F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(0)), F.lit(4))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (remainder == 2).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(remainder != 2)
    out = scored(docs, fitted(docs.filter("not held_out"), labels))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
