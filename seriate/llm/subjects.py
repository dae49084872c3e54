"""Subjects of posts, by labelling functions whose accuracies a latent model learns.

Labelling functions look at a post and a subject and give a level (or none):

* lexicon: how many of the post's sentences, and which share, the lexicon gives to the subject;
* remark: whether these sentences are of a kind that names things in passing (how often a kind of sentence agrees with its post's subject is learned);
* section: whether the opening, and the closing, paragraph is about it;
* address: what the host of the post's links is usually about;
* source: what the board is usually about.

The lexicon (words and pairs of words that occur nearly only with one subject) is fitted on a bounded sample of posts labelled by hand. The latent
model sees every post: posts are counted by their levels, and expectation maximisation learns from these counts how often each function gives each
level for posts that are about a subject and for those that are not. The labelled posts anchor what is what. Each post gets the subjects whose
posterior probability is at least one half.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriate.llm.posts import own_paragraphs
from seriate.operators.skew import look_up
from seriate.session import materialize

#: The lexicon is fitted on at most so many labelled posts, those with the least hash of their id.
MAX_LABELLED = 20_000
NONE = "none"
#: A lexicon entry belongs to its subject by this share, given equally many posts of each, and by more than chance.
PURITY, CHANCE = 0.7, 1.5

_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"(?<=[.!?])\s+")
#: Sentences this long at most are one vote; a longer text without stops is cut into stretches of so many words.
STRETCH = 60


def sentences(paragraph: str) -> Iterator[list[str]]:
    """The words of each sentence; sentences may go on over line breaks."""
    for s in _STOP.split(paragraph.lower()):
        words = _WORD.findall(s)
        if len(words) <= STRETCH:
            if words:
                yield words
        else:
            for at in range(0, len(words), STRETCH):
                yield words[at : at + STRETCH]


def terms(words: list[str]) -> set[str | tuple[str, str]]:
    """Words and pairs of neighbouring words; numbers say nothing."""
    said = [None if w.isdigit() else w for w in words]
    return {w for w in said if w} | {p for p in zip(said, said[1:]) if p[0] and p[1]}


class Lexicon:
    """Terms with their subject and weight, and how far kinds of sentences can be trusted.

    A term enters if its posts are of its subject more often than chance would have it, given how many terms are tried: the excess over the
    subject's share of all posts is over ``sqrt(CHANCE ln T)`` standard deviations, where ``T`` terms are tried (with a ``CHANCE`` of 2 hardly any of ``T``
    terms that say nothing would reach it). The test is the same for any number of labels.
    """

    def __init__(self, subjects: list[str], labelled: list[tuple[str | None, frozenset[str]]]):
        self.subjects = subjects
        classes = [*subjects, NONE]
        posts: Counter[str] = Counter()
        seen: dict[str | tuple[str, str], Counter[str]] = defaultdict(Counter)
        parsed = [([(s, terms(s)) for p in own_paragraphs(text)[0] for s in sentences(p)], labels) for text, labels in labelled]
        for said, labels in parsed:
            if len(labels) != 1:
                continue
            (label,) = labels
            posts[label] += 1
            for t in set().union(*[ts for _, ts in said]):
                seen[t][label] += 1
        self.words: dict[str, tuple[str, float]] = {}
        self.pairs: dict[str, dict[str, tuple[str, float]]] = {}
        n_posts = sum(posts.values())
        least = math.sqrt(CHANCE * math.log(max(2, len(seen))))
        for t, by in seen.items():
            n = sum(by.values())
            rates = {c: (by[c] + 0.01) / (posts[c] + 1) for c in classes}
            best = max(classes, key=rates.__getitem__)
            purity = rates[best] / sum(rates.values())
            if purity < PURITY:
                continue
            share = posts[best] / n_posts
            if by[best] - n * share <= least * math.sqrt(n * share * (1 - share)):
                continue
            weight = min(4.0, math.log(purity / (1 - purity) if purity < 1 else 1e9)) * min(1.0, n / 4)
            if isinstance(t, tuple):
                self.pairs.setdefault(t[0], {})[t[1]] = (best, weight * 2)
            else:
                self.words[t] = (best, weight)
        # Kinds of sentences: of those with a term, how often the sentence's subject is one of the post's.
        right: Counter[tuple[str, str]] = Counter()
        total: Counter[tuple[str, str]] = Counter()
        self.kinds: dict[str, set[str]] = {}
        for said, labels in parsed:
            for s, ts in said:
                subject = self.subject(s)
                if subject is None or subject == NONE:
                    continue
                for t in ts:
                    if isinstance(t, tuple) and t[1] not in self.pairs.get(t[0], ()):
                        total[t] += 1
                        right[t] += subject in labels
        for (first, second), n in total.items():
            if n >= 5 and right[first, second] / n < 0.6:
                self.kinds.setdefault(first, set()).add(second)

    def subject(self, words: list[str]) -> str | None:
        """The subject that a sentence speaks of, if its terms agree enough."""
        score: dict[str, float] = {}
        alone, pairs = self.words, self.pairs
        for w in set(words):
            if w in alone:
                subject, weight = alone[w]
                score[subject] = score.get(subject, 0.0) + weight
        hits = {(a, b) for a, b in zip(words, words[1:]) if a in pairs and b in pairs[a]}
        for a, b in hits:
            subject, weight = pairs[a][b]
            score[subject] = score.get(subject, 0.0) + weight
        if not score:
            return None
        best = max(sorted(score), key=score.__getitem__)
        rest = sum(score.values()) - score[best]
        return best if score[best] > 2 and score[best] > 1.5 * rest else None

    def remark(self, words: list[str]) -> bool:
        """Whether the sentence is of a kind that mostly names things in passing."""
        kinds = self.kinds
        return any(a in kinds and b in kinds[a] for a, b in zip(words, words[1:]))

    def levels(self, text: str | None) -> tuple[dict[str, tuple[int, int, int, int]], list[str]]:
        """Levels of lexicon, remark, opening and closing for each subject named in a post, and the post's hosts."""
        paragraphs, hosts = own_paragraphs(text)
        votes: list[tuple[int, str, bool]] = []
        n = last = 0
        for p in paragraphs:
            before = n
            for s in sentences(p):
                n += 1
                subject = self.subject(s)
                if subject:
                    votes.append((last, subject, self.remark(s)))
            last += n > before
        out = {}
        real = [v for v in votes if not v[2]]
        spoken = len(real) or 1
        for subject in {v[1] for v in votes} - {NONE}:
            firm = sum(v[1] == subject for v in real)
            passing = sum(v[1] == subject for v in votes) - firm
            share = firm / spoken
            lexicon = 0 if not firm else 1 + 4 * (min(firm, 3) - 1) + (share >= 0.2) + (share >= 0.4) + (share >= 0.75)
            remark = 0 if not passing else 1 if firm else 2 + (n <= 2) + 2 * (len(votes) == passing)
            opening = 1 + any(v[0] == 0 and v[1] == subject for v in real)
            closing = 0 if last < 2 else 1 + any(v[0] == last - 1 and v[1] == subject for v in real)
            out[subject] = (lexicon, remark, opening, closing)
        return out, hosts


def clean_labels(labels: DataFrame, doc_id: str, subject: str) -> DataFrame:
    """Distinct labels in lower case and without blanks around them; null ids and labels are left out."""
    name = F.lower(F.trim(F.col(subject), F.lit(" \t\n\r")))
    return labels.select(F.col(doc_id).alias("doc_id"), name.alias("subject")).where("doc_id IS NOT NULL AND subject <> ''").distinct()


def fit_lexicon(docs: DataFrame, labels: DataFrame, subjects: list[str], most: int = MAX_LABELLED) -> Lexicon:
    """The lexicon of at most ``most`` labelled posts (``doc_id, text`` and ``doc_id, subject``), those with the least hashes of their ids."""
    per_doc = labels.where(F.col("subject").isin([*subjects, NONE])).groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    chosen = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    return Lexicon(subjects, [(r["text"], frozenset(r["labels"])) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))])


LEVELS = ["lexicon", "remark", "opening", "closing", "address", "source"]


def post_levels(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, source, hosts, subject, lexicon, remark, opening, closing``: a row per post and subject named in it; one with a null subject for the others."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kinds = [("source", pa.string()), ("hosts", pa.list_(pa.string())), ("subject", pa.string()), *[(c, pa.int32()) for c in LEVELS[:4]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            ids, rows = [], []
            for doc, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found, hosts = lex.levels(text)
                hosts = sorted(set(hosts))
                for subject, levels in sorted(found.items()) or [(None, (0, 0, 0, 0))]:
                    ids.append(doc)
                    rows.append((source, hosts, subject, *levels))
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *[pa.array(c, k) for c, (_, k) in zip(cols, kinds)]], names=["doc_id", *[n for n, _ in kinds]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("source").cast("string"), "text").mapInArrow(run, f"doc_id {kind}, source string, hosts array<string>, subject string, lexicon int, remark int, opening int, closing int")


def _usual(levels: DataFrame, by: str) -> DataFrame:
    """What posts of one source or host are usually about: ``by``, ``subject`` and a level from 1 (hardly ever) to 4 (mostly)."""
    firm = levels.where(F.col(by).isNotNull())
    # Counting combines on the map side, so a source that holds a third of all posts is no burden.
    n = firm.where("subject IS NOT NULL AND lexicon >= 4").groupBy(by, "subject").agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy(by).agg(F.sum("n").alias("n_all")), by).select(by, "subject", (F.lit(1) + (F.col("n") * 20 >= F.col("n_all")).cast("int") + (F.col("n") * 5 >= F.col("n_all")).cast("int") + (F.col("n") * 2 >= F.col("n_all")).cast("int")).alias("level"))


def with_usual(levels: DataFrame) -> DataFrame:
    """Levels with those of address and source: 0 where nothing is known."""
    out = levels.where("subject IS NOT NULL")
    # A post speaks for each of its hosts, and the one that says most for the subject counts.
    # Most posts have no link.
    linked = out.where(F.size("hosts") > 0)
    each = _usual(linked.withColumn("host", F.explode("hosts")), "host")
    sets = linked.select("hosts", "subject").distinct().withColumn("host", F.explode("hosts"))
    address = sets.join(each, ["host", "subject"]).groupBy("hosts", "subject").agg(F.max("level").alias("__address"))
    usual = _usual(levels, "source").select("source", "subject", F.col("level").alias("__source"))
    # One board or host may have a third of all posts.
    linked = look_up(linked, materialize(address, "addresses"), ["hosts", "subject"])
    out = linked.unionByName(out.where("NOT coalesce(size(hosts) > 0, false)").withColumn("__address", F.lit(None).cast("int")))
    out = look_up(materialize(out, "addressed"), materialize(usual, "sources"), ["source", "subject"])
    return out.select("doc_id", "subject", *LEVELS[:4], F.coalesce("__address", F.lit(0)).alias("address"), F.coalesce("__source", F.lit(0)).alias("source"))


class LatentModel:
    """Posts are about a subject or not; given that, the functions' levels are independent. Learned from counts of level patterns.

    The labelled posts of a pattern correct the model where its functions are not independent: a pattern's posterior is the mean of the model's, which
    counts as ``MODEL_WEIGHT`` posts, and of its labelled posts.
    """

    MODEL_WEIGHT = 5.0

    def __init__(self, patterns: list[tuple[tuple[int, ...], int, int, int]], rounds: int = 30, anchor: float = 5.0):
        """``patterns``: levels, number of posts without a label, and of labelled posts that are and are not about the subject."""
        self.prior, self.tables = 0.5, []
        self.labelled = {levels: (about, other) for levels, _, about, other in patterns}
        width = len(patterns[0][0]) if patterns else 0
        # Before anything is learned: more sentences and a greater share make a subject likelier.
        belief = {levels: self._corrected(levels, min(0.95, max(0.05, 0.1 + 0.09 * levels[0]))) for levels, *_ in patterns}
        for _ in range(rounds):
            yes, no = [defaultdict(float) for _ in range(width)], [defaultdict(float) for _ in range(width)]
            n_yes = n_no = 0.0
            for levels, free, about, other in patterns:
                p = belief[levels]
                y, n = free * p + anchor * about, free * (1 - p) + anchor * other
                n_yes, n_no = n_yes + y, n_no + n
                for k, v in enumerate(levels):
                    yes[k][v] += y
                    no[k][v] += n
            self.prior = (n_yes + 1) / (n_yes + n_no + 2)
            values = [{levels[k] for levels, *_ in patterns} for k in range(width)]
            self.tables = [{v: math.log((yes[k][v] + 0.5) / (n_yes + 0.5 * len(values[k]))) - math.log((no[k][v] + 0.5) / (n_no + 0.5 * len(values[k]))) for v in values[k]} for k in range(width)]
            belief = {levels: self.posterior(levels) for levels, *_ in patterns}

    def _corrected(self, levels: tuple[int, ...], p: float) -> float:
        about, other = self.labelled.get(levels, (0, 0))
        return (self.MODEL_WEIGHT * p + about) / (self.MODEL_WEIGHT + about + other)

    def posterior(self, levels: tuple[int, ...]) -> float:
        score = math.log(self.prior / (1 - self.prior)) + sum(t.get(v, 0.0) for t, v in zip(self.tables, levels))
        return self._corrected(levels, 1 / (1 + math.exp(-max(-50.0, min(50.0, score)))))


def assign_subjects(docs: DataFrame, labels: DataFrame, subjects: list[str], threshold: float = 0.5) -> DataFrame:
    """``doc_id, subject, probability`` for the subjects of each post (``docs`` has ``doc_id, text, source``; ``labels`` ``doc_id, subject``).

    Posts without words of their own, and posts that name no subject, have no row. Labels other than ``subjects`` and ``none`` are ignored; without any
    label there is no lexicon and no result. Null ids come out as null. A post repeated with one id counts as often in the model, and once in the result.
    """
    labels = clean_labels(labels, "doc_id", "subject")
    lexicon = fit_lexicon(docs, labels, subjects)
    levels = materialize(with_usual(materialize(post_levels(docs, lexicon), "votes")), "levels")
    known = labels.groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    marked = levels.join(known, "doc_id", "left")
    about = F.array_contains("labels", F.col("subject"))
    # One row per pattern of levels: bounded by the levels, whatever the number of posts.
    counts = marked.groupBy(*LEVELS).agg(
        F.sum(F.when(F.col("labels").isNull(), 1).otherwise(0)).alias("free"), F.sum(F.when(about, 1).otherwise(0)).alias("about"), F.sum(F.when(~about, 1).otherwise(0)).alias("other")
    )
    patterns = [(tuple(r[c] for c in LEVELS), r["free"], r["about"], r["other"]) for r in counts.orderBy(*LEVELS).collect()]
    model = LatentModel(patterns)
    schema = ", ".join(f"{c} int" for c in LEVELS) + ", probability double"
    posteriors = docs.sparkSession.createDataFrame([(*p[0], model.posterior(p[0])) for p in patterns], schema)
    scored = levels.join(F.broadcast(posteriors.where(F.col("probability") >= threshold)), LEVELS)
    return scored.groupBy("doc_id", "subject").agg(F.max("probability").alias("probability"))
