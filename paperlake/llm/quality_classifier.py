"""Weakly supervised quality classifier (operator 8).

Overlapping heuristic labellers vote clean, junk or toxic, or abstain. Expectation-maximisation over
the counts of all vote patterns estimates every labeller's confusion matrix and the class shares.
The posteriors label a bounded sample of documents, on which a hashed linear scorer is trained; the
scorer then decides on every document from its text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.kernels import EXACT, FOLDED, U, Words, batch, buffers, chunks, filter_rows, lean, mix, sole
from paperlake.session import prepare

CLASSES = ("clean", "junk", "toxic")
BUCKETS = 1 << 18
#: Documents of each class that the scorer is fitted on, at most.
TRAIN_PER_CLASS = 3000
#: Share of their votes in which people are taken to be right; the other labellers' shares are estimated.
PEOPLE_RIGHT = 0.97
PREFIX = 6
#: Each labeller is taken to abstain at least this often in every class.
LEAST_ABSTAINING = 0.2
#: Features of the sample that a training step looks at together.
BLOCK = 1 << 20
#: Weight of a text's hashed features, which are shares, against the votes.
TEXT_SCALE = 40.0
#: Words by which short texts are taken to be longer, so that a single word decides little.
PADDING = 60
#: A stem is marked when this many labelled toxic documents have it, at this many times the clean documents' rate.
MARKED_DOCS, MARKED_RATIO = 4, 5.0
SENT_LABELS = 4_000_000
INSULTS = "idiot idiots stupid moron morons trash scum loser losers pathetic worthless disgusting clown clowns dumb imbecile jerk scumbag vermin filth filthy bastard bastards asshole bitch shit fuck fucking crap dumbass retard retarded freak creep pig swine cretin dimwit nitwit idiota estúpido imbécil basura asqueroso abruti connard salaud débile crétin trottel arschloch idioten dummkopf abschaum".split()
FUNCTION_WORDS = "the of and to in a is that it for on with as was be by this are at from or an not have had but they you der die das und in zu den von mit ist des sich auf für im dem nicht ein eine als auch le la les de des et en un une du que qui dans pour par sur au est pas ce plus el los las y que en un una por con para del se no lo su al".split()
LABELLERS = ("symbols", "pipes", "shouting", "exclaiming", "repeating", "plain prose", "an insult", "marked stems", "people")

_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{}~|"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | (np.arange(256) >= 97) & (np.arange(256) <= 122) | (np.arange(256) >= 128)
_BANG = np.arange(256) == 33
_PIPE = np.arange(256) == 124


def _prints(texts: list[str], lut: np.ndarray) -> np.ndarray:
    data, offsets = buffers(pa.array(texts))
    return np.sort(Words(data, offsets, lut).print)


_INSULT, _FUNCTION = _prints(INSULTS, FOLDED), _prints(sorted(set(FUNCTION_WORDS)), FOLDED)


def _among(prints: np.ndarray, few: np.ndarray) -> np.ndarray:
    """isin() with a table look-up first."""
    table = np.zeros(1 << 16, bool)
    table[(few >> U(48)).astype(np.int64)] = True
    hit = np.flatnonzero(table[(prints >> U(48)).astype(np.int64)])
    out = np.zeros(len(prints), bool)
    out[hit] = np.isin(prints[hit], few)
    return out


def _vote(*cases: tuple[np.ndarray, int]) -> np.ndarray:
    """1 + class of the first case that holds, 0 where none does."""
    return np.select([c for c, _ in cases], [np.int64(v + 1) for _, v in cases], np.int64(0))


class Looked:
    """Votes and hashed features of some rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, marks: np.ndarray | None = None):
        plain, folded = Words(data, offsets, EXACT), Words(data, offsets, FOLDED)
        lo, rows = int(offsets[0]), len(offsets) - 1
        part, at = data[lo : int(offsets[-1])], offsets - lo

        def share(kind: np.ndarray) -> np.ndarray:
            total = np.zeros(len(part) + 1, np.int64)
            np.cumsum(kind[part], out=total[1:])
            return (total[at[1:]] - total[at[:-1]]).astype(float)

        count = lambda w, of=None: np.bincount(w.row if of is None else w.row[of], minlength=rows).astype(float)
        n, m = count(plain), count(folded)
        size = np.maximum(count(plain), 1)
        letters = np.maximum(share(_LETTER), 1)
        symbols, upper = share(_SYMBOL) / np.maximum(share(_LETTER) + share(_SYMBOL), 1), share(_UPPER) / letters
        again = np.flatnonzero((folded.print[1:] == folded.print[:-1]) & (folded.row[1:] == folded.row[:-1])) + 1
        repeats = count(folded, again) / np.maximum(m, 1)
        known = count(folded, _among(folded.print, _FUNCTION)) / np.maximum(m, 1)
        bad = count(folded, _among(folded.print, _INSULT))
        some = n >= 5
        stem = np.zeros(len(folded.start), U)
        for k in range(PREFIX):
            at_k = folded.start + k
            stem = stem << U(8) | np.where(at_k < folded.end, FOLDED[data[np.minimum(at_k, folded.end - 1)]], 0).astype(U)
        stems = (mix(stem) >> U(64 - 18)).astype(np.int64)
        marked = np.zeros(rows) if marks is None else count(folded, np.flatnonzero(marks[stems]))
        pipes, bangs = share(_PIPE) / size, share(_BANG) / size
        self.votes = np.stack([
            _vote((some & (symbols > 0.08), 1)),
            _vote((some & (pipes > 0.1), 1)),
            _vote((some & (upper > 0.5), 1)),
            _vote((some & (bangs > 0.2), 1)),
            _vote((some & (repeats > 0.2), 1)),
            _vote((((known > 0.1) | (m < 20)) & (symbols < 0.04) & (upper < 0.2) & (pipes + bangs < 0.1) & (repeats < 0.1), 0), ((m >= 20) & (known < 0.03), 1)),
            _vote((bad >= 1, 2)),
            _vote(((marked >= 2) & (marked >= 0.01 * m), 2)),
            np.zeros(rows, np.int64),
        ])
        ids = lambda w, salt: ((w.print ^ U(salt)) >> U(64 - 18)).astype(np.int64)
        self.row = np.concatenate([plain.row, folded.row, folded.row])
        self.id = np.concatenate([ids(plain, 0), ids(folded, 0x5BD1E9955BD1E995), stems])
        self.stem_row, self.stem = folded.row, stems
        self.total = n + 2 * m
        self.sample = np.zeros(rows, U)
        np.add.at(self.sample, plain.row, plain.print)
        self.rows = rows

    def pattern(self, people: np.ndarray | None = None) -> np.ndarray:
        votes = self.votes.copy()
        if people is not None:
            votes[-1] = people
        return (votes * 4 ** np.arange(len(votes))[:, None]).sum(axis=0)

    def dense(self) -> np.ndarray:
        """One weight index per labeller but the people: votes are features as well."""
        return BUCKETS + np.arange(len(LABELLERS) - 1)[:, None] * 4 + self.votes[:-1]


def _look(column: pa.Array, marks: np.ndarray | None = None):
    data, offsets = buffers(column)
    for i, j in chunks(offsets, 1 << 20):
        yield i, j, Looked(data, offsets[i : j + 1], marks)


_MARK = pa.schema([("bucket", pa.int32()), ("toxic_docs", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])


@lean
def _mark_rows(batches):
    """Counts of stems in documents that people call toxic or clean."""
    sole({})
    total = np.zeros((3, BUCKETS), np.int64)
    for rows in batches:
        people = rows.column(1).to_numpy(zero_copy_only=False)
        for i, j, seen in _look(rows.column(0)):
            bad = people[i:j][seen.stem_row] == 3
            total[1] += np.bincount(seen.stem[bad], minlength=BUCKETS)
            total[2] += np.bincount(seen.stem[~bad], minlength=BUCKETS)
            once = np.unique(seen.stem_row[bad] * BUCKETS + seen.stem[bad]) % BUCKETS
            total[0] += np.bincount(once, minlength=BUCKETS)
    used = np.flatnonzero(total.any(axis=0))
    if len(used):
        yield batch(_MARK, bucket=used.astype(np.int32), toxic_docs=total[0, used], toxic=total[1, used], clean=total[2, used])


def marked_stems(own: DataFrame) -> np.ndarray:
    """Which stem buckets are typical of labelled toxic documents: at most BUCKETS rows reach the driver."""
    got = own.where("people in (1, 3)").mapInArrow(_mark_rows, "bucket int, toxic_docs long, toxic long, clean long").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in _MARK.names[1:])).toPandas()
    marks = np.zeros(BUCKETS, bool)
    if len(got) and got["toxic"].sum() and got["clean"].sum():
        rate = (got["toxic"] / got["toxic"].sum()) / ((got["clean"] + 1) / got["clean"].sum())
        marks[got["bucket"][(got["toxic_docs"] >= MARKED_DOCS) & (rate >= MARKED_RATIO)]] = True
    return marks


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior by pattern, class shares, confusion[labeller, class, vote]) of a Dawid-Skene model.

    It starts from the share of votes each class has, with a weak vote for clean everywhere. Only how
    often people are right is given.
    """
    votes = (patterns[:, None] // 4 ** np.arange(len(LABELLERS))) % 4
    q = np.stack([(votes == c + 1).sum(axis=1) + 9 * (votes[:, -1] == c + 1) for c in range(3)], axis=1) * np.array([0.5, 2.0, 4.0]) + 0.1
    q /= q.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        w = q * counts[:, None]
        shares = (w.sum(axis=0) + 1) / (w.sum() + 3)
        confusion = np.stack([np.stack([w[votes[:, k] == v].sum(axis=0) for v in range(4)], axis=1) + 0.1 for k in range(len(LABELLERS))])
        confusion /= confusion.sum(axis=2, keepdims=True)
        # Abstaining says little: labellers share causes, which the model takes to be independent.
        spoken = np.minimum(confusion[:, :, 1:].sum(axis=2, keepdims=True), 1 - LEAST_ABSTAINING)
        confusion[:, :, 1:] *= spoken / confusion[:, :, 1:].sum(axis=2, keepdims=True)
        confusion[:, :, :1] = 1 - spoken
        said = 1 - confusion[-1, :, :1]
        confusion[-1, :, 1:] = said * np.where(np.eye(3, dtype=bool), PEOPLE_RIGHT, (1 - PEOPLE_RIGHT) / 2)
        logs = np.log(shares) + sum(np.log(confusion[k][:, votes[:, k]]).T for k in range(len(LABELLERS)))
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done, q = np.abs(new - q).max() < 1e-6, new
        if done:
            break
    return q, shares, confusion


def _pattern_rows(marks):
    @lean
    def run(batches):
        sole({})
        for rows in batches:
            people = rows.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, seen in _look(rows.column(0), marks.value):
                p, c = np.unique(seen.pattern(people[i:j]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(c)], names=["pattern", "n"])

    return run


_SAMPLE = pa.schema([("cls", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary()), ("values", pa.binary()), ("q", pa.binary())])


def _sample_rows(model):
    @lean
    def run(batches):
        sole({})
        patterns, q, rates, marks = model.value
        for rows in batches:
            people = rows.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, seen in _look(rows.column(0), marks):
                own = q[np.searchsorted(patterns, seen.pattern(people[i:j]))]
                cls = own.argmax(axis=1)
                rate = rates[(people[i:j] > 0).astype(int), cls]
                rank = (seen.sample >> U(12)).astype(np.int64)
                out, dense, border = [], seen.dense(), None
                for r in np.flatnonzero((rank < rate * 2.0**52) & (seen.total > 0)):
                    if border is None:
                        order = np.argsort(seen.row, kind="stable")
                        border = np.searchsorted(seen.row[order], np.arange(seen.rows + 1))
                    ids, n = np.unique(seen.id[order[border[r] : border[r + 1]]], return_counts=True)
                    ids, values = np.r_[ids, dense[:, r]], np.r_[TEXT_SCALE * n / (seen.total[r] + PADDING), np.ones(len(dense))]
                    out.append((int(cls[r]), int(rank[r]), ids.astype("<i4").tobytes(), values.astype("<f4").tobytes(), own[r].astype("<f8").tobytes()))
                if out:
                    yield batch(_SAMPLE, **dict(zip(_SAMPLE.names, zip(*out))))

    return run


def train(sample: list, rounds: int = 40) -> np.ndarray:
    """Weights [feature, class] of a softmax scorer on soft labels, by AdaGrad over the whole sample."""
    size = BUCKETS + 4 * (len(LABELLERS) - 1)
    weights, past = np.zeros((size, 3)), np.full((size, 3), 1e-8)
    if not sample:
        weights[BUCKETS:, 0] = 1.0
        return weights
    n = len(sample)
    cut = np.r_[0, np.cumsum([len(s.ids) // 4 for s in sample])]
    q = np.stack([np.frombuffer(s.q, "<f8") for s in sample])
    cls = np.array([s.cls for s in sample])
    ids, values = np.frombuffer(b"".join(s.ids for s in sample), "<i4"), np.frombuffer(b"".join(s.values for s in sample), "<f4")
    sample.clear()
    seen = np.zeros(size, bool)
    seen[ids] = True
    used = np.flatnonzero(seen)
    ids = (np.cumsum(seen, dtype=np.int32) - 1)[ids]
    w, g2 = np.zeros((len(used), 3)), past[: len(used)]
    balance = 1 / np.maximum(np.bincount(cls, minlength=3), 1)[cls]
    balance /= balance.sum()
    # Blocks of documents bound what is held besides the sample itself.
    blocks = np.unique(np.r_[np.searchsorted(cut, np.arange(0, cut[-1], BLOCK)), n])
    for _ in range(rounds):
        g = 1e-5 * w
        for a, b in zip(blocks[:-1], blocks[1:]):
            own, x = ids[cut[a] : cut[b]], values[cut[a] : cut[b]]
            doc = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(cut[a : b + 1]))
            z = np.stack([np.bincount(doc, w[own, c] * x, b - a) for c in range(3)], axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - q[a:b]) * balance[a:b, None]
            g += np.stack([np.bincount(own, d[doc, c] * x, len(used)) for c in range(3)], axis=1)
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
    weights[used] = w
    return weights


def _probabilities(seen: Looked, weights: np.ndarray) -> np.ndarray:
    z = np.stack([np.bincount(seen.row, weights[seen.id, c], seen.rows) * (TEXT_SCALE / (seen.total + PADDING)) for c in range(3)], axis=1)
    z += weights[seen.dense()].sum(axis=0)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


_OUT = pa.schema([("doc_id", pa.int64()), ("p_clean", pa.float64()), ("p_junk", pa.float64()), ("p_toxic", pa.float64()), ("keep", pa.bool_())])


def _judge(column: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    weights, marks = model
    p = np.zeros((len(column), 3))
    blank = np.zeros(len(column), bool)
    for i, j, seen in _look(column, marks):
        p[i:j], blank[i:j] = _probabilities(seen, weights), seen.total == 0
    return p, ~blank & (p[:, 0] >= 0.5)


def _score_rows(model):
    @lean
    def run(batches):
        sole({})
        for rows in batches:
            p, keep = _judge(rows.column(1), model.value)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(p[:, c]) for c in range(3)), pa.array(keep)], schema=_OUT)

    return run


def _keep_rows(model, at: int):
    @lean
    def run(batches):
        sole({})
        for rows in batches:
            yield rows.filter(pa.array(_judge(rows.column(at), model.value)[1]))

    return run


def people_votes(labels: DataFrame) -> DataFrame:
    """(good, people): one vote for each labelled document; toxic goes before junk, and where rows differ the worse one holds."""
    code = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).when(F.col("quality") == 1, 1).otherwise(0)
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("good")).agg(F.max(code).alias("people"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the scorer, marked stems); vote patterns of all documents are counted, at most `per_class` of each class are sampled."""
    spark = prepare(docs.sparkSession)
    votes = people_votes(labels)
    if votes.limit(SENT_LABELS + 1).count() <= SENT_LABELS:
        votes = F.broadcast(votes)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    own = own.join(votes, F.col("id") == F.col("good"), "left").select("text", F.coalesce("people", F.lit(0)).alias("people"))
    # At most 4 ** labellers patterns, whatever the number of documents.
    marks = marked_stems(own)
    sent = spark.sparkContext.broadcast(marks)
    got = own.mapInArrow(_pattern_rows(sent), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    if not len(got):
        return train([]), marks
    patterns, n = got["pattern"].to_numpy(), got["n"].to_numpy()
    q, _, _ = expectation_maximisation(patterns, n)
    # Documents that people labelled go first; others fill what they leave.
    by_people = patterns // 4 ** (len(LABELLERS) - 1) > 0
    other, told = (np.bincount(q[s].argmax(axis=1), n[s], minlength=3) if s.any() else np.zeros(3) for s in (~by_people, by_people))
    rates = np.stack([np.maximum(per_class - told, 0) / np.maximum(other, 1), per_class / np.maximum(told, 1)])
    model = spark.sparkContext.broadcast((patterns, q, np.minimum(1, rates), marks))
    sampled = own.mapInArrow(_sample_rows(model), "cls int, rank long, ids binary, values binary, q binary")
    return train(sorted(sampled.collect())), marks


def classify(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """(doc_id, p_clean, p_junk, p_toxic, keep) of every row; kept when p_clean is 0.5 or more.

    Null, empty and blank texts are not kept. Rows that stand twice are judged alike, a null doc_id
    stays null and has no label, an empty table gives no rows. Columns other than doc_id and text of
    `docs`, and doc_id, quality and toxic of `labels`, are not read.
    """
    model = prepare(docs.sparkSession).sparkContext.broadcast(fit(docs, labels, per_class))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score_rows(model), "doc_id long, p_clean double, p_junk double, p_toxic double, keep boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """The rows of `docs`, with all their columns, that classify() keeps; nothing is shuffled."""
    model = prepare(docs.sparkSession).sparkContext.broadcast(fit(docs, labels, per_class))
    return filter_rows(docs, _keep_rows(model, docs.columns.index("text")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
