"""Toxicity by weak supervision.

1. Voters look at a text, each at evidence of its own: word lists by theme in four languages, a second-person address before such a word,
   several themes, masked and stretched spellings, shouting, runs of marks, links; and words and stems that labelled rows show to speak
   for label 1 or 0. A voter fires or says nothing. Those whose firing on labelled rows doesn't go with their side are silenced.
2. All texts outside the held-out fold are voted on, labelled or not, and counted by the set of voters that fired. A generative label model
   over these counts estimates by EM how often each voter fires given the hidden class and given the voter that it is most correlated
   with inside the classes: these pairs make a forest, so that the same evidence counts once though several voters bring it.
3. A logistic regression over words is trained on the posteriors of a sample of those texts. It alone scores texts, whole ones, of any length.

Labels serve to mine words and stems, to silence voters and for the share of toxic rows, which the label model takes as given; lang, source,
doc_id and labels are never inputs of a score. Samples are drawn by a hash and bounded by parameters: `most` rows of each label, and
`most_texts` texts from each side of the posterior, give or take chance; copies of a text count once in them. The counts cover all rows.

A doc_id labelled both 0 and 1 counts as not labelled; the same label twice counts once. Null texts count as empty; empty texts get the
score of the intercept. Without labelled rows of both kinds, or without a voter left, every score is the share of toxic rows among the
labelled ones (0 if none). Repeated rows get equal scores. An empty table gives an empty result. An input column named like the score,
held_out or predicted is replaced; all others stay, and none clashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage, textvec

MAX_LABELLED = 3000
MAX_TEXTS = 6000
FOLDS = 5
#: Bytes of the stems of words, those of under so many being their own.
STEMS = (4, 5, 6)
#: Words of abuse by theme, in English, French, German and Spanish.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic stupid stupidity dumb fool fools imbecile clown clowns brainless "
    "idiote imbécile débile crétin bouffon stupide abruti dumm dummkopf blöd depp trottel vollidiot idiota estúpido estúpida tonto imbécil payaso",
    "worth": "worthless loser losers pathetic useless trash garbage scum vermin filth "
    "minable raté ordure vermine racaille wertlos versager abschaum müll nichtsnutz inútil perdedor basura escoria patético",
    "disgust": "disgusting revolting repulsive nasty vile sickening dégoûtant répugnant immonde ekelhaft widerlich abstoßend asqueroso repugnante",
    "violence": "kill murder strangle slaughter tuer crever égorger töten umbringen abstechen matar degollar",
    "obscene": "shit bullshit crap bastard bitch asshole fuck fucking merde connard salope putain scheiße arschloch hurensohn wichser mierda cabrón puta gilipollas",
}
ADDRESS = "you your yours u tu toi vous ton ta votre du dich dir dein deine ihr tú te ti usted eres vos"
#: Voters in the order of their bits, and whether their firing speaks for label 1.
VOTERS = (*((theme, True) for theme in LEXICONS), ("address", True), ("themes", True), ("masked", True), ("stretched", True), ("shouting", True), ("marks", True),
          ("mined words", True), ("mined stems", True), ("mined clean words", False), ("links", False))
BIT = {name: 1 << k for k, (name, _) in enumerate(VOTERS)}


@dataclass
class Model:
    """Weights of some word hashes, which are sorted, and the intercept."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for at, rows, own, word, stems in words(column):
            total = np.full(rows, self.bias)
            row, k = incidence(*features(own, word, stems), self.words)
            if len(row):
                total += np.bincount(row, self.weights[k], rows)
            out[at : at + rows] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return out


def incidence(own: np.ndarray, word: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, number of the word in the sorted vocabulary), once for each word that a text has."""
    if not len(vocabulary) or not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
    hit = vocabulary[k] == word
    keys = np.unique(own[hit] * len(vocabulary) + k[hit])
    return keys // len(vocabulary), keys % len(vocabulary)


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(first row, rows, text, hash, hash of each stem) of each lower-cased word without punctuation. Stems are hashed apart from words."""
    import pyarrow.compute as pc

    for at, rows, *_ in textvec.slices(column):  # lower-cased slice by slice: a batch may hold much text
        lower = pc.utf8_lower(column.slice(at, rows).cast(pa.large_string()).fill_null(""))
        _, _, data, offsets = next(textvec.slices(lower, most_bytes=1 << 62))
        starts, ends, first = textvec.word_spans(data, offsets, textvec.PUNCTUATION)
        word, *stems = textvec.prefix_hashes(data, starts, ends, STEMS)
        yield at, rows, np.repeat(np.arange(rows), np.diff(first)), word, [textvec.mix64(x + np.uint64(n)) for n, x in zip(STEMS, stems, strict=True)]


def features(own: np.ndarray, word: np.ndarray, stems: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of words and stems together."""
    return np.tile(own, 1 + len(stems)), np.concatenate([word, *stems])


def held_out() -> F.Column:
    """Whether crc32 of the decimal doc_id is divisible by FOLDS."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def hashes_of(listed: str) -> np.ndarray:
    """Sorted word hashes of a list, as words() makes them."""
    return np.unique(np.concatenate([word for *_, word, _ in words(pa.array([listed]))]))


@dataclass
class Mined:
    """Sorted hashes of words that speak for label 1, stems that do, and words that speak for label 0."""

    toxic: np.ndarray
    stems: np.ndarray
    clean: np.ndarray

    @classmethod
    def nothing(cls) -> Mined:
        return cls(*(np.zeros(0, np.uint64) for _ in range(3)))


class Voting:
    """codes() gives the set of voters that fire on each text, as bits."""

    def __init__(self, mined: Mined):
        self.mined = mined
        self.themes = [hashes_of(listed) for listed in LEXICONS.values()]
        self.address = hashes_of(ADDRESS)

    def codes(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), np.int64)
        for at, rows, own, word, stems in words(column):
            bits = out[at : at + rows]
            abuse, themes = np.zeros(len(word), bool), np.zeros(rows, np.int64)
            for theme, listed in zip(LEXICONS, self.themes, strict=True):
                hit = np.isin(word, listed)
                fired = np.bincount(own[hit], minlength=rows) > 0
                bits |= fired * BIT[theme]
                themes += fired
                abuse |= hit
            bits |= (themes >= 2) * BIT["themes"]
            toxic = np.isin(word, self.mined.toxic)
            abuse |= toxic
            near = np.isin(word, self.address)
            stem = np.zeros(len(word), bool)
            for x in stems:
                stem |= np.isin(x, self.mined.stems)
            before = np.zeros(len(word), bool)
            for k in (1, 2, 3):
                before[k:] |= near[:-k] & (own[k:] == own[:-k])
            for name, hit in (("address", abuse & before), ("mined words", toxic), ("mined stems", stem), ("mined clean words", np.isin(word, self.mined.clean))):
                bits |= (np.bincount(own[hit], minlength=rows) > 0) * BIT[name]
        for at, rows, data, offsets in textvec.slices(column):
            bits = out[at : at + rows]
            for name, hit, width in byte_patterns(data):
                first = np.searchsorted(offsets, np.flatnonzero(hit), side="right") - 1
                last = np.searchsorted(offsets, np.flatnonzero(hit) + width - 1, side="right") - 1
                bits |= (np.bincount(first[first == last], minlength=rows) > 0) * BIT[name]
            upper, letters = (np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets]) for table in (_UPPER, _LETTER))
            bits |= ((letters >= 20) & (2 * upper > letters)) * BIT["shouting"]
        return out


def _bytes(test: Callable[[str], bool]) -> np.ndarray:
    return np.array([k < 0x80 and test(chr(k)) for k in range(256)])


_UPPER, _LETTER = _bytes(str.isupper), _bytes(str.isalpha)
_MASK, _MARK = _bytes(lambda c: c in "*#@$"), _bytes(lambda c: c in "!?")


def byte_patterns(data: np.ndarray) -> Iterator[tuple[str, np.ndarray, int]]:
    """(voter, whether its pattern starts at each byte, width of the pattern)."""
    if len(data) < 4:
        return
    letter, mask, mark = _LETTER[data], _MASK[data], _MARK[data]
    yield "masked", letter[:-2] & mask[1:-1] & mask[2:], 3
    same = data[1:] == data[:-1]
    yield "stretched", same[:-2] & same[1:-1] & same[2:] & letter[:-3], 4
    yield "marks", mark[:-2] & mark[1:-1] & mark[2:], 3
    yield "links", (data[:-2] == ord(":")) & (data[1:-1] == ord("/")) & (data[2:] == ord("/")), 3


@dataclass
class LabelModel:
    """Votes given the hidden class: each voter fires with a chance that depends on the class and on whether its parent fired, parents making
    a forest. rate: class x voter; parent: -1 at roots; chance: class x parent silent or fired x voter, equal at roots."""

    prior: float
    rate: np.ndarray
    parent: np.ndarray
    chance: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Chance of class 1 for each row of votes."""
        voter = np.arange(len(self.parent))
        above = np.where(self.parent >= 0, fired[:, self.parent], 0)
        at = [np.where(above, self.chance[c, 1, voter], self.chance[c, 0, voter]) for c in range(2)]
        log = [np.where(fired, np.log(x), np.log1p(-x)).sum(axis=1) for x in at]
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + log[1] - log[0], -30, 30)))


def label_model(fired: np.ndarray, count: np.ndarray, toxic: np.ndarray, prior: float, rounds: int = 200) -> tuple[np.ndarray, LabelModel]:
    """(posterior of class 1 of each row, the model) from the votes alone, by EM: first with independent voters, then with the forest of
    their strongest correlations given the class.

    fired: rows x voters, 0 or 1; count: how many texts a row stands for; toxic: the side of each voter, which only says where EM starts.
    """
    fired = fired.astype(np.int64)
    lead = fired[:, toxic].sum(axis=1) - fired[:, ~toxic].sum(axis=1)
    p = np.where(lead > 0, 0.9, 0.1 * prior)
    for correlated in (False, True):
        parent = forest(fired, np.stack([(1 - p) * count, p * count])) if correlated else np.full(fired.shape[1], -1)
        for _ in range(rounds):
            model = estimated(fired, np.stack([(1 - p) * count, p * count]), parent, prior, toxic)
            before, p = p, model.posterior(fired)
            if np.abs(p - before).max() < 1e-9:
                break
    return p, model


def estimated(fired: np.ndarray, by: np.ndarray, parent: np.ndarray, prior: float, toxic: np.ndarray) -> LabelModel:
    """The model of most likely rates where row k counts by[c, k] in class c and no voter fires more often in the class it speaks against. A
    pseudo-text of even odds keeps rates off 0 and 1, and a chance given a parent starts as one pseudo-text of the voter's rate."""
    more = np.where(toxic, 1, 0)
    voter = np.arange(fired.shape[1])

    def on_its_side(hits: np.ndarray, texts: np.ndarray) -> np.ndarray:
        rate = hits / texts
        wrong = rate[more, voter] < rate[1 - more, voter]
        return np.where(wrong, hits.sum(axis=0) / texts.sum(axis=0), rate)

    rate = on_its_side(by @ fired + 0.5, np.repeat(by.sum(axis=1, keepdims=True) + 1, len(voter), axis=1))
    chance = np.stack([rate, rate], axis=1)
    child = np.flatnonzero(parent >= 0)
    for v in range(2):
        above = fired[:, parent] == v
        given = on_its_side(by @ (above * fired) + rate, by @ above + 1)
        chance[:, v, child] = given[:, child]
    return LabelModel(prior, rate, parent, chance)


def forest(fired: np.ndarray, by: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """Parent of each voter, -1 at roots: the spanning forest of greatest mutual information given the class, as Chow and Liu build it,
    without pairs that share less than `least` nats a text."""
    m, total = fired.shape[1], by.sum()
    shared = np.zeros((m, m))
    for c in range(2):
        n = max(by[c].sum(), 1e-12)
        for u, v in ((0, 0), (0, 1), (1, 0), (1, 1)):
            x, y = (fired == u).astype(float), (fired == v).astype(float)
            both, alone = (x * by[c][:, None]).T @ y / n, np.outer(by[c] @ x / n, by[c] @ y / n)
            shared += n / total * np.where(both > 0, both * np.log(np.maximum(both, 1e-300) / np.maximum(alone, 1e-300)), 0)
    np.fill_diagonal(shared, 0)
    parent, inside, reach, near = np.full(m, -1), np.zeros(m, bool), np.full(m, -np.inf), np.full(m, -1)
    for _ in range(m):
        j = int(np.argmax(np.where(inside, -np.inf, np.maximum(reach, -1e9))))
        inside[j] = True
        parent[j] = near[j] if reach[j] >= least else -1
        closer = ~inside & (shared[j] > reach)
        reach[closer], near[closer] = shared[j][closer], j
    return parent


def surprise_column(bad: Column, n: Column, p: float) -> Column:
    """surprise_of() in Spark."""
    q = F.least(F.greatest(bad / n, F.lit(1e-9)), F.lit(1 - 1e-9))
    return n * (q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p)))


def surprise_of(bad: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Minus the log of the Chernoff bound that bad of n tosses come out with chance p."""
    q = np.clip(bad / np.maximum(n, 1e-9), 1e-9, 1 - 1e-9)
    return n * (q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p)))


def regress(n: int, row: np.ndarray, column: np.ndarray, vocabulary: np.ndarray, target: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, rounds: int = 200, l2: float = 1e-5) -> Model:
    """Weighted logistic regression on soft targets of n texts by Adam on all of them; text row[k] has the word vocabulary[column[k]]. start:
    weights to begin with, 0 if not given."""
    mean = float(np.clip(np.average(target, weights=weight), 1e-4, 1 - 1e-4))
    m, bias, total = len(vocabulary), float(np.log(mean / (1 - mean))), weight.sum()
    w, m1, m2 = np.zeros(m) if start is None else start.astype(float), np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, w[column], n)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / total
        g = np.append(np.bincount(column, error[row], m) + l2 * w, error.sum())
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-3)  # errors too small to matter move nothing
        w -= step[:-1]
        bias -= step[-1]
    return Model(vocabulary, w, bias)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _chance(*columns: str) -> Column:
    """A number from 0 to 1 by hash."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) + F.lit(0.5)) / float(1 << 30)


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[DataFrame, dict[int, int]]:
    """(y, text of about `most` rows of each label outside the held-out fold, rows of each label); rows of equal label and text count once."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    rows = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).where("toxic = high").select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, most / max(counts.get(1, 0), 1)).otherwise(most / max(counts.get(0, 0), 1))
    picked = _texts(docs).join(F.broadcast(rows.where(_chance("doc_id") < share)), "doc_id")
    return picked.groupBy("toxic", F.md5(F.col("text").cast("binary"))).agg(F.first("text").alias("text")).select(F.col("toxic").cast("double").alias("y"), "text"), counts


def _distinct(own: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct row (text, value, ...)."""
    order = np.lexsort((*values, own))
    new = np.ones(len(own), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (own, *values)], axis=0)
    return order[new]


def telling(rows: DataFrame, kind: Callable[..., tuple[np.ndarray, np.ndarray]], surprise: float = 13.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted entries whose texts' y is far from chance, the mean y of each, the mean y of a word). rows: y (0 to 1), text; kind: what words() gives -> (text, entries).

    An entry is tossed once for each pair of neighbours it stands between, against the mean y of all words; it is kept if the Chernoff bound of
    the tosses is below exp(-surprise), less than one by chance in some 400,000. Copies, near copies and shared passages repeat neighbours, so
    a passage counts once however often it occurs. Entries that fall through by whole texts already aren't looked at with neighbours.
    """

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy()
            for at, n, own, word, stems in words(batch.column(1)):
                who, h = kind(own, word, stems)
                first = _distinct(who, h)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(y[at + who[first]]), pa.array(np.zeros(len(first), np.int64))], names=["h", "y", "words"])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(y[at : at + n]), pa.array(np.bincount(own, minlength=n))], names=["h", "y", "words"])

    seen = storage.table(rows.mapInArrow(textvec.freeing(by_text), "h long, y double, words long").groupBy("h").agg(F.count("*").alias("n"), F.sum("y").alias("bad"), F.sum("words").alias("words"), F.sum(F.col("y") * F.col("words")).alias("bad_words")))
    texts = seen.where("h = 0").first()
    if texts is None or not texts["words"] or not 0 < texts["bad_words"] < texts["words"]:
        return np.zeros(0, np.uint64), np.zeros(0), 0.0
    mean = texts["bad_words"] / texts["words"]
    far = seen.where("h <> 0").where(surprise_column(F.col("bad"), F.col("n"), texts["bad"] / texts["n"]) >= surprise).select("h").toArrow()
    candidates = np.sort(far.column("h").to_numpy().view(np.uint64))
    storage.drop(seen)

    def by_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy()
            for at, _, own, word, stems in words(batch.column(1)):
                around = np.zeros(len(word), np.uint64)
                if len(word) > 1:
                    same = own[1:] == own[:-1]
                    around[1:] += np.where(same, textvec.mix64(word[:-1]), np.uint64(0))
                    around[:-1] ^= np.where(same, word[1:], np.uint64(0))
                who, h = kind(own, word, stems)
                hit = np.flatnonzero(np.isin(h, candidates))
                around = around[hit % max(len(word), 1)]
                first = _distinct(who[hit], h[hit], around)
                yield pa.RecordBatch.from_arrays([pa.array(h[hit][first].view(np.int64)), pa.array(around[first].view(np.int64)), pa.array(y[at + who[hit][first]])], names=["h", "around", "y"])

    tosses = rows.mapInArrow(textvec.freeing(by_neighbours), "h long, around long, y double").groupBy("h", "around").agg(F.avg("y").alias("y")).groupBy("h").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))
    kept = tosses.where(surprise_column(F.col("bad"), F.col("n"), mean) >= surprise).toArrow()
    h, n, bad = (kept.column(k).to_numpy() for k in ("h", "n", "bad"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], (bad / np.maximum(n, 1))[order], mean


def _words_only(own: np.ndarray, word: np.ndarray, stems: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return own, word


def _stems_only(own: np.ndarray, word: np.ndarray, stems: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(own, len(stems)), np.concatenate(stems)


def mine(labelled: DataFrame) -> Mined:
    """Words and stems that labelled rows (y, text) show to speak for a side: label 1 prevails, at more than double odds, or is a quarter as frequent."""
    word, q, mean = telling(labelled, _words_only)
    stem, r, _ = telling(labelled, _stems_only)
    for_toxic = lambda q: (q >= 0.5) & (q > 2 * mean / (1 + mean))
    return Mined(word[for_toxic(q)], stem[for_toxic(r)], word[q < mean / 4])


def voters_heard(labelled: DataFrame, mined: Mined) -> np.ndarray:
    """Whether each voter's firing on labelled rows (y, text) goes with its side: label 1 has at least double odds there, or half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = Voting(mined)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(voting.codes(batch.column(1)))], names=["y", "code"])

    counted = labelled.select("y", "text").mapInArrow(textvec.freeing(run), "y double, code long").groupBy("y", "code").count().collect()
    toxic, code, n = (np.array([r[k] for r in counted]).astype(np.int64) for k in ("y", "code", "count"))
    odds = lambda y1, y0: (y1 + 0.5) / (y0 + 0.5)
    base = odds(n[toxic == 1].sum(), n[toxic == 0].sum())
    heard = []
    for name, for_toxic in VOTERS:
        fires = code & BIT[name] > 0
        own = odds(n[fires & (toxic == 1)].sum(), n[fires & (toxic == 0)].sum()) / base
        heard.append(bool(fires.any()) and (own >= 2 if for_toxic else own <= 0.5))
    return np.array(heard)


def vote_counts(docs: DataFrame, mined: Mined) -> tuple[np.ndarray, np.ndarray]:
    """(sets of voters that fired, number of texts of each) over all texts outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = Voting(mined)
        for batch in batches:
            code, count = np.unique(voting.codes(batch.column(0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], names=["code", "n"])

    rows = _texts(docs).where(~held_out()).select("text").mapInArrow(textvec.freeing(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], float)


def sampled_texts(docs: DataFrame, mined: Mined, codes: np.ndarray, p: np.ndarray, share: np.ndarray) -> DataFrame:
    """y (the posterior), weight, text of the texts outside the held-out fold that a hash takes, of each code the share given; copies of a text count once."""
    order = np.argsort(codes)
    codes, p, share = codes[order], p[order], share[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = Voting(mined)
        for batch in batches:
            k = np.searchsorted(codes, voting.codes(batch.column(1)))
            keep = batch.column(0).to_numpy() < share[k]
            yield pa.RecordBatch.from_arrays([pa.array(p[k][keep]), pa.array(1 / share[k][keep]), batch.column(1).filter(pa.array(keep))], names=["y", "weight", "text"])

    rows = _texts(docs).where(~held_out()).select(_chance("text").alias("u"), "text").where(F.col("u") < float(share.max()))
    taken = rows.mapInArrow(textvec.freeing(run), "y double, weight double, text string")
    return taken.groupBy(F.md5(F.col("text").cast("binary"))).agg(*(F.first(c).alias(c) for c in ("y", "weight", "text"))).select("y", "weight", "text")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_texts: int = MAX_TEXTS) -> Model:
    """The classifier; it holds no more words than its sample. Samples of texts are tables; to the driver come counts by set of voters, and
    the words that matter."""
    labelled, counts = labelled_texts(docs, labels, most)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    constant = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    if not 0 < prior < 1:
        return constant
    labelled = storage.table(labelled)
    mined = mine(labelled)
    heard = voters_heard(labelled, mined)
    storage.drop(labelled)
    if not heard.any():
        return constant
    codes, count = vote_counts(docs, mined)
    if not len(codes):
        return constant
    fired = (codes[:, None] >> np.flatnonzero(heard)) & 1
    p, _ = label_model(fired, count, np.array([side for _, side in VOTERS])[heard], prior)
    share = np.minimum(1, most_texts * (p / max((count * p).sum(), 1) + (1 - p) / max((count * (1 - p)).sum(), 1)))
    sample = storage.table(sampled_texts(docs, mined, codes, p, share))
    model = regressed(sample)
    storage.drop(sample)
    return model or constant


def regressed(sample: DataFrame) -> Model | None:
    """The regression on rows (y, weight, text) over words and stems that tell: the many rare words would otherwise learn the sample by heart.
    Each starts from its own log odds, so that a word doesn't stay weak only because it seldom stands alone. None if there are no words."""
    vocabulary, q, mean = telling(sample.select("y", "text"), features)
    logit = lambda x: np.log(np.clip(x, 0.02, 0.98) / (1 - np.clip(x, 0.02, 0.98)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, *found in words(batch.column(2)):
                row, column = incidence(*features(*found), vocabulary)
                per = np.split(column, np.searchsorted(row, np.arange(1, n)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(per, pa.list_(pa.int64()))], names=["y", "weight", "has"])

    has = sample.select("y", "weight", "text").mapInArrow(textvec.freeing(run), "y double, weight double, has array<long>").groupBy("y", "weight", "has").count().toArrow()  # texts with the same words are one row
    if not len(has):
        return None
    lists = has.column("has").combine_chunks()
    weight = has.column("weight").to_numpy() * has.column("count").to_numpy()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return regress(len(lists), row, lists.flatten().to_numpy(), vocabulary, has.column("y").to_numpy(), weight, logit(q) - logit(mean))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score column between 0 and 1; rows are scored where they lie, and only their texts go to Python."""

    @F.arrow_udf("double")
    def of_text(column: pa.Array) -> pa.Array:
        return pa.array(model.score(column), pa.float64())

    own = [c for c in docs.columns if c.lower() != name.lower()]
    return docs.select(*(F.col(f"`{c}`") for c in own), of_text(F.col("text").cast("string")).alias(name))


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_texts: int = MAX_TEXTS) -> DataFrame:
    """docs with held_out, score and predicted."""
    scored = score(docs, fit(docs, labels, most, most_texts))
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= 0.5).cast("int")})
