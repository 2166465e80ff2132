"""Subject areas of documents, by labelling functions and a latent model that learns their accuracies.

1. Every text is read into its spoken cues (folded words), and blocks of documents into term numbers.
2. A lexicon is learned. Its seeds are the terms of a bounded sample of labelled documents and of the subjects'
   descriptions; then all documents in which it finds subjects teach it again (PASSES times). A term belongs to a subject if
   its cues lie in documents of that subject (purity, a lower bound) and if it is much more common there than in all
   documents of the same language (so that small talk of a language with few labels isn't taken for a subject). Rarely
   taught terms follow the terms of their stem, whatever the language. Terms of several subjects count for the one that
   the document shows otherwise. The lexicon stays a table: each block of documents gets the part of it that it uses.
3. Labelling functions vote on each (document, subject): lexicon (share of the spoken cues), section (whether several
   thirds of the document reach the share), address (words of web addresses), source (how common the subject is there).
4. The votes form few patterns. Annotators vote too, on the documents they labelled. Expectation maximisation learns from
   the patterns' counts in all documents how common each subject is, and how each function votes on documents with and
   without it, the truth being hidden, as annotators err as well. No function counts as worse than chance, and one that
   doesn't vote adds nothing. A document has a subject if some of its cues are about it and its posterior from the
   functions' votes is at least a half.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.core.runtime import map_arrow, materialise, ship_package
from millrace.llm.subtitles import cues, folded, hosts, spoken_words

#: the share of spoken cues that makes a subject, and where the lexicon function's votes change
SHARE, BINS = 0.2, (0.05, 0.1, 0.15, 0.2)
#: at most so many labelled documents are learned from, by the hash of their id
LABELLED_SAMPLE = 20_000
#: a term needs so many documents, whatever the size of the corpus
LEAST_DOCS = 3
#: so often all documents teach the lexicon after its seeds
PASSES = 1
#: a term to the subject that holds PURE of its weight (as a seed PURE_SEED), or to those that hold PART each and FEW together
PURE_SEED, PURE, PART, FEW = 0.5, 0.6, 0.25, 0.7
#: how much more common than in other documents of its language a term must be in those of the subject
ODDS_SEED, ODDS = 5.0, 2.0
#: terms that begin with the same so many letters are alike
STEM = 5
#: source votes: how much more or less common than everywhere, and by how many standard errors
_LIFT, _ERRORS = 1.5, 3.0
#: a block of documents that share a part of the lexicon ends at so many documents or characters
_BLOCK_DOCS, _BLOCK_CHARS = 2_000, 4_000_000
_BLOCKS = "block long, doc_id array<long>, source array<string>, lang array<string>, n_cues array<int>, vocabulary array<string>, tokens binary, cue_sizes binary, places binary, place_sizes array<int>"
_VOTES = "doc_id long, source string, s int, lexicon int, section int, address int, annotator int, n long"


def document_blocks(documents: DataFrame) -> DataFrame:
    """A row for each block of neighbouring documents: their ids, sources, languages and numbers of spoken cues, the terms
    of the block, and the terms' numbers in each cue and in each document's web addresses.

    Null and empty texts have no cue. Columns `lang` and `source` may be missing. Block numbers hold for this one run, so
    the result is to be materialised.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Builder()
        for b in batches:
            for doc, source, lang, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "lang", "text")), strict=True):
                block.add(doc, source, lang, text)
                if len(block.ids) >= _BLOCK_DOCS or block.size >= _BLOCK_CHARS:
                    yield block.row(number)
                    number, block = number + 1, _Builder()
        if block.ids:
            yield block.row(number)

    own = {c: F.col(c).cast("string") if c in documents.columns else F.lit(None).cast("string") for c in ("source", "lang", "text")}
    lang = F.lower(F.trim(F.coalesce(own["lang"], F.lit(""))))
    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), own["source"].alias("source"), lang.alias("lang"), own["text"].alias("text")), read, _BLOCKS)


class _Builder:
    def __init__(self):
        self.ids, self.sources, self.langs, self.n_cues, self.place_sizes = [], [], [], [], []
        self.index: dict[str, int] = {}
        self.of_cue: dict[str, tuple[int, ...]] = {}
        self.tokens, self.cue_sizes, self.places, self.size = [], [], [], 0

    def add(self, doc: int | None, source: str | None, lang: str, text: str | None) -> None:
        index, n = self.index, 0
        for c in cues(text):
            if (words := spoken_words(c)) is None:
                continue
            if (terms := self.of_cue.get(words)) is None:
                terms = self.of_cue[words] = tuple({index.setdefault(t, len(index)) for t in words.split()})
            self.tokens += terms
            self.cue_sizes.append(len(terms))
            n += 1
        places = [index.setdefault(t, len(index)) for t in sorted(hosts(text))]
        self.places += places
        self.place_sizes.append(len(places))
        self.ids.append(doc)
        self.sources.append(source)
        self.langs.append(lang)
        self.n_cues.append(n)
        self.size += len(text or "")

    def row(self, number: int) -> pa.RecordBatch:
        packed = lambda v: pa.array([np.array(v, np.uint32).tobytes()], pa.binary())
        lists = lambda v, t: pa.array([v], pa.list_(t))
        columns = [pa.array([number], pa.int64()), lists(self.ids, pa.int64()), lists(self.sources, pa.string()), lists(self.langs, pa.string()), lists(self.n_cues, pa.int32()), lists(list(self.index), pa.string())]
        columns += [packed(self.tokens), packed(self.cue_sizes), packed(self.places), lists(self.place_sizes, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCKS.split(", ")])


@dataclass
class Block:
    """One block of documents, as arrays: the terms of each cue of each document."""

    ids: pa.Array
    sources: pa.Array
    langs: pa.Array
    vocabulary: pa.Array
    n_cues: np.ndarray
    tokens: np.ndarray
    cue: np.ndarray  # of each token
    doc: np.ndarray  # of each cue
    places: np.ndarray
    place_doc: np.ndarray

    @classmethod
    def of(cls, row: pa.Table) -> Block:
        at = {c: row.column(c)[0] for c in row.column_names}
        n_cues, sizes = at["n_cues"].values.to_numpy(), np.frombuffer(at["cue_sizes"].as_py(), np.uint32)
        docs, places = np.arange(len(n_cues)), at["place_sizes"].values.to_numpy()
        return cls(
            at["doc_id"].values, at["source"].values, at["lang"].values, at["vocabulary"].values, n_cues,
            np.frombuffer(at["tokens"].as_py(), np.uint32).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), np.repeat(docs, n_cues),
            np.frombuffer(at["places"].as_py(), np.uint32).astype(np.int64), np.repeat(docs, places),
        )

    def about(self, lexicon: dict[int, list[int]], k: int) -> np.ndarray:
        """Cues about each subject in each third of each document: (documents, 3, subjects). `lexicon` has the subjects of
        the block's terms by their numbers; a term of several counts for the one with most cues otherwise, if any."""
        n, size = len(self.n_cues), len(self.vocabulary)
        pure, mixed = np.full(size, -1), np.full(size, -1)
        options = []
        for t, of in lexicon.items():
            if len(of) == 1:
                pure[t] = of[0]
            else:
                mixed[t] = len(options)
                options.append(np.isin(np.arange(k), of))
        own = pure[self.tokens]
        hits = np.unique(self.cue[own >= 0] * k + own[own >= 0])
        total = np.bincount(self.doc[hits // k] * k + hits % k, minlength=n * k).reshape(n, k)
        several = mixed[self.tokens]
        if options and (several >= 0).any():
            at = self.cue[several >= 0]
            seen = np.array(options)[several[several >= 0]] * total[self.doc[at]]
            best = seen.argmax(1)
            some = seen.max(1) > 0
            hits = np.unique(np.r_[hits, at[some] * k + best[some]])
        cue, s = hits // k, hits % k
        doc = self.doc[cue]
        first = np.cumsum(self.n_cues) - self.n_cues
        third = (cue - first[doc]) * 3 // np.maximum(self.n_cues[doc], 1)
        return np.bincount((doc * 3 + third) * k + s, minlength=n * 3 * k).reshape(n, 3, k)

    def labels(self, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(whether annotators saw the document, the share of them that gave each subject)."""
        ids, weights = known
        own = self.ids.fill_null(np.iinfo(np.int64).min).to_numpy()
        if not len(ids):
            return np.zeros(len(own), bool), np.zeros((len(own), weights.shape[1]))
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        seen = ids[at] == own
        return seen, np.where(seen[:, None], weights[at], 0.0)


def label_weights(labels: DataFrame, subjects: list[str], sample: int = LABELLED_SAMPLE) -> DataFrame:
    """(doc_id, weights): the share of a document's annotators that gave each subject; at most `sample` documents. A null
    annotator is one of them; labels without document or subject don't count."""
    given = labels.selectExpr("CAST(doc_id AS bigint) AS doc_id", "labelled_by", "lower(trim(subject)) AS subject").where("doc_id IS NOT NULL AND subject IS NOT NULL")
    ks = range(len(subjects))
    flags = ", ".join(f"max(CAST(subject = {_quoted(s)} AS int)) AS s{i}" for i, s in enumerate(subjects))
    sums = ", ".join(f"CAST(sum(s{i}) / count(1) AS float)" for i in ks)
    one = labels.sparkSession.sql(f"SELECT doc_id, labelled_by, {flags} FROM {{given}} GROUP BY doc_id, labelled_by", given=given)
    by = labels.sparkSession.sql(f"SELECT doc_id, array({sums}) AS weights FROM {{one}} GROUP BY doc_id", one=one)
    return by.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)


def _quoted(text: str) -> str:
    """An SQL literal in the form `label_weights` compares by."""
    return "'" + "".join(c if c.isalnum() or c == " " else f"\\u{ord(c):04x}" if ord(c) < 65536 else f"\\U{ord(c):08x}" for c in text.strip().lower()) + "'"


def described_terms(subjects: list[tuple[str, str | None]]) -> list[tuple[str, int]]:
    """(term, subject's index) of the words of names and descriptions, with and without a plural's s; only terms of one."""
    found: dict[str, set[int]] = {}
    for i, (name, text) in enumerate(subjects):
        for w in folded(f"{name} {text or ''}").split():
            for t in {w, w.removesuffix("s")}:
                found.setdefault(t, set()).add(i)
    return sorted((t, min(of)) for t, of in found.items() if len(of) == 1 and len(t) > 2)


def _own_lexicon(own: pa.Table) -> dict[int, list[int]]:
    return dict(zip(own.column("id").to_pylist(), own.column("options").to_pylist(), strict=True))


def _with_lexicon(blocks: DataFrame, terms: DataFrame, run, schema: str) -> DataFrame:
    """`run` over each block with its own part of the lexicon, whatever the lexicon's size."""
    ship_package(blocks.sparkSession)
    own = blocks.select(F.col("block").alias("b"), F.posexplode("vocabulary").alias("id", "term")).join(terms, "term").select("b", "id", "options")
    return blocks.groupBy("block").cogroup(own.groupBy("b")).applyInArrow(run, schema)


def taught_terms(blocks: DataFrame, terms: DataFrame | None, known, k: int) -> DataFrame:
    """(term, lang, docs, taught, cues, w, o), added up within blocks: the documents with the term, those of them that teach,
    the cues with it in those, and for each subject their weights by cues and by documents. Rows without a term are of all
    documents of the language.

    A document teaches by the subjects that the lexicon `terms` finds in it (with two cues or more), else by its labels.
    """
    schema = "term string, lang string, docs long, taught long, cues long, w array<float>, o array<float>"

    def rows(block: Block, lexicon: dict[int, list[int]]) -> pa.Table:
        seen, w = block.labels(known.value)
        if lexicon:
            by = block.about(lexicon, k).sum(1)
            found = (by >= SHARE * block.n_cues[:, None]) & (by > 1)
            some = found.any(1)
            seen, w = seen | some, np.where(some[:, None], found, w)
        size = len(block.vocabulary)
        langs = block.langs.dictionary_encode()
        lang = langs.indices.to_numpy()
        # each term of each document once, with its number of cues
        pairs, times = np.unique(block.doc[block.cue] * np.int64(size) + block.tokens, return_counts=True)
        doc, term = np.divmod(pairs, max(size, 1))
        group, of = np.unique(lang[doc] * np.int64(size) + term, return_inverse=True)
        m, t = len(group), seen[doc]
        add = lambda v: np.bincount(of[t], v[t], m)
        columns = [np.bincount(of, minlength=m), add(np.ones(len(of))), add(times), np.stack([add(times * w[doc, s]) for s in range(k)], 1), np.stack([add(w[doc, s]) for s in range(k)], 1)]
        spoken, n = block.n_cues > 0, len(langs.dictionary)
        use = spoken & seen
        all_ = lambda mask, v: np.bincount(lang[mask], v[mask], n)
        ones = np.ones(len(spoken))
        whole = [all_(spoken, ones), all_(use, ones), np.zeros(n), np.zeros((n, k)), np.stack([all_(use, w[:, s]) for s in range(k)], 1)]
        names = pa.concat_arrays([block.vocabulary.take(pa.array(group % max(size, 1))), pa.nulls(n, pa.string())])
        tongues = pa.concat_arrays([langs.dictionary.take(pa.array(group // max(size, 1))), langs.dictionary])
        numbers = [pa.array(np.r_[a, b].astype(np.int64)) for a, b in zip(columns[:3], whole[:3], strict=True)]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (m + n) * k + 1, k), pa.int32()), pa.array(np.r_[a, b].ravel(), pa.float32())) for a, b in zip(columns[3:], whole[3:], strict=True)]
        return pa.Table.from_arrays([names, tongues, *numbers, *lists], [c.split()[0] for c in schema.split(", ")])

    if terms is not None:
        return _with_lexicon(blocks, terms, lambda block, own: rows(Block.of(block), _own_lexicon(own)), schema)

    def every(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from rows(Block.of(pa.Table.from_batches([b.slice(i, 1)])), {}).to_batches()

    return map_arrow(blocks, every, schema)


def lexicon_terms(taught: DataFrame, described: list[tuple[str, int]], k: int, pure: float, odds: float) -> DataFrame:
    """(term, options): terms of LEAST_DOCS documents that belong to one subject, or to few, by the subjects' indices.

    With `pi` the share of a subject among the teaching documents, a term is `odds` times as common in its documents as in
    others if its documents number odds / (1 + (odds - 1) pi) times what all documents of their languages let expect.
    """
    spark, ks = taught.sparkSession, range(k)
    each = lambda form: ", ".join(form.replace("#", str(i)) for i in ks)
    whole = spark.sql(f"SELECT lang, sum(docs) AS n, sum(taught) AS use, {each('sum(o[#]) AS n#')} FROM {{taught}} WHERE term IS NULL GROUP BY lang", taught=taught)
    use, *sizes = spark.sql(f"SELECT coalesce(sum(use), 0), {each('coalesce(sum(n#), 0)')} FROM {{whole}}", whole=whole).first()  # a number a subject
    least = [odds / (1 + (odds - 1) * (n + 1) / (use + k)) for n in sizes]
    by = spark.sql(f"SELECT term, lang, sum(docs) AS docs, sum(taught) AS taught, sum(cues) AS cues, {each('sum(w[#]) AS w#')}, {each('sum(o[#]) AS o#')} FROM {{taught}} WHERE term IS NOT NULL GROUP BY term, lang", taught=taught)
    by = spark.sql(f"SELECT term, docs, taught, cues, {each('w#')}, {each('o#')}, {each('n# * docs / greatest(n, 1) AS e#')} FROM {{by}} JOIN {{whole}} USING (lang)", by=by, whole=whole)
    if described:
        said = spark.createDataFrame(described, "term string, s int")
        said = said.selectExpr("term", "0L AS docs", "0L AS taught", "1L AS cues", *[f"CAST(s = {i} AS double) AS {x}{i}" for x in "wo" for i in ks], *[f"0D AS e{i}" for i in ks])
        by = by.unionByName(said)
    # purity is a lower bound, so that rare terms need purer evidence
    r = ", ".join(f"CASE WHEN o{i} >= {least[i]}D * e{i} THEN (w{i} - sqrt(w{i} * greatest(1 - w{i} / greatest(cues, 1), 0D))) / (greatest(cues, 1) + 1) ELSE 0D END" for i in ks)
    shares = spark.sql(f"SELECT term, taught, array({r}) AS r FROM (SELECT term, sum(docs) AS docs, sum(taught) AS taught, sum(cues) AS cues, {each('sum(w#) AS w#, sum(o#) AS o#, sum(e#) AS e#')} FROM {{by}} GROUP BY term) WHERE docs >= {LEAST_DOCS}", by=by)
    shares = materialise(shares)
    options = f"filter(transform(r, (x, i) -> CASE WHEN x >= {PART} THEN i END), i -> i IS NOT NULL)"
    belongs = f"CASE WHEN size(options) = 1 THEN array_max(r) >= {pure} WHEN size(options) > 1 THEN aggregate(filter(r, x -> x >= {PART}), 0D, (a, x) -> a + x) >= {FEW} ELSE false END"
    found = shares.selectExpr("term", "taught", "r", f"{options} AS options").selectExpr("term", "taught", f"CASE WHEN {belongs} THEN options END AS options")
    # rarely taught terms follow their stem, if all its terms are of one subject
    stem = f"CASE WHEN length(term) >= {STEM} THEN substring(term, 1, {STEM}) END AS stem"
    stems = found.where("size(options) = 1").selectExpr(stem, "options[0] AS s").where("stem IS NOT NULL").groupBy("stem").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    stems = stems.where("low = high").selectExpr("stem", "array(low) AS options")
    alike = found.where(f"taught < {LEAST_DOCS} AND options IS NULL").selectExpr("term", stem).join(stems, "stem").select("term", "options")
    return found.where("options IS NOT NULL").select("term", "options").unionByName(alike)


def votes(blocks: DataFrame, terms: DataFrame, known, k: int) -> DataFrame:
    """The votes on (document, subject), a row for each pair with a cue vote (`n` null), and the numbers `n` of all pairs of a
    source with the same votes (doc_id null). Documents without a spoken cue take no part.

    lexicon: number of BINS that the share reaches; section: 2 if at least two thirds of the document reach the share, with
    three cues or more, else 1, and 0 (no vote) in documents of less than three cues; address: 1 if a web address names the subject, else 0 (no vote); annotator: 2 if
    at least half of them gave the subject, 1 if not, 0 no vote.
    """

    def run(block_: pa.Table, own: pa.Table) -> pa.Table:
        block, lexicon = Block.of(block_), _own_lexicon(own)
        by = block.about(lexicon, k)
        n = block.n_cues[:, None]
        sizes = np.stack([-(-block.n_cues * (i + 1) // 3) + (-block.n_cues * i // 3) for i in range(3)], 1)
        total = by.sum(1)
        level = sum((total >= b * n - 1e-9) & (total > 0) for b in BINS).astype(np.int64)
        reached = ((by >= SHARE * np.maximum(sizes, 1)[:, :, None]) & (by > 0)).sum(1)
        section = np.where(n < 3, 0, np.where((reached > 1) & (total > 2), 2, 1))  # a stray cue or two fill no sections
        address = np.zeros_like(level)
        for t, d in zip(block.places.tolist(), block.place_doc.tolist(), strict=True):
            if len(of := lexicon.get(t, ())) == 1:
                address[d, of[0]] = 1
        seen, weights = block.labels(known.value)
        annotator = np.where(seen[:, None], 1 + (weights >= 0.5), 0)
        sources = block.sources.dictionary_encode()
        source = sources.indices.fill_null(len(sources.dictionary)).to_numpy()
        doc, s = np.nonzero(np.broadcast_to(n > 0, level.shape))
        code = source[doc]
        for v, size in ((s, k), (level[doc, s], len(BINS) + 1), (section[doc, s], 3), (address[doc, s], 2), (annotator[doc, s], 3)):
            code = code * size + v
        patterns, times = np.unique(code, return_counts=True)
        rest, parts = patterns, []
        for size in (3, 2, 3, len(BINS) + 1, k):
            rest, v = np.divmod(rest, size)
            parts.insert(0, v)
        d, i = np.nonzero((level > 0) & (n > 0))
        pairs = [i, level[d, i], section[d, i], address[d, i], annotator[d, i]]
        where = pa.array(np.r_[source[d], rest], mask=np.r_[source[d], rest] == len(sources.dictionary))
        columns = [pa.concat_arrays([block.ids.take(pa.array(d)), pa.nulls(len(times), pa.int64())]), sources.dictionary.take(where)]
        columns += [pa.array(np.r_[a, b].astype(np.int32)) for a, b in zip(pairs, parts, strict=True)]
        columns.append(pa.concat_arrays([pa.nulls(len(d), pa.int64()), pa.array(times.astype(np.int64))]))
        return pa.Table.from_arrays(columns, [c.split()[0] for c in _VOTES.split(", ")])

    return _with_lexicon(blocks, terms, run, _VOTES)


def source_votes(patterns: DataFrame) -> DataFrame:
    """(vs, vi, vote) of (source, subject): 2 common there, 1 rare there; only where the difference is no chance."""
    at = F.sum(F.when(F.col("lexicon") > BINS.index(SHARE), F.col("n")).otherwise(0))
    base = patterns.groupBy(F.col("s").alias("bs")).agg((at / F.sum("n")).alias("all"))
    by = patterns.where("source IS NOT NULL").groupBy("source", "s").agg((at / F.sum("n")).alias("here"), F.sum("n").alias("n"))
    by = by.join(F.broadcast(base), F.col("s") == F.col("bs"))
    far = F.abs(F.col("here") - F.col("all")) >= _ERRORS * F.sqrt(F.col("all") * (1 - F.col("all")) / F.col("n"))
    vote = F.when(far & (F.col("here") >= _LIFT * F.col("all")), 2).when(far & (F.col("here") * _LIFT <= F.col("all")), 1)
    return by.select(F.col("source").alias("vs"), F.col("s").alias("vi"), vote.alias("vote")).where("vote IS NOT NULL")


#: functions with the number of their votes; the vote 0 of all but the lexicon is none
_KINDS = {"lexicon": len(BINS) + 1, "section": 3, "address": 2, "source": 3, "annotator": 3}


def learn_accuracies(subject: np.ndarray, x: np.ndarray, counts: np.ndarray, k: int, rounds: int = 100) -> tuple[np.ndarray, list[np.ndarray]]:
    """Expectation maximisation over vote patterns: (prior of each subject, P(vote | has it), P(vote | has it not) of each
    function). One accuracy a function, shared by all subjects; the hidden truth starts from the lexicon's vote at the
    share, and functions are taken as independent given it. Functions that say yes or no are judged by their votes,
    those that only say yes by how often they do. None is worse than chance."""
    post = (x[:, 0] > BINS.index(SHARE)) * 0.98 + 0.01
    prior, tables = np.full(k, 0.5), []
    for _ in range(rounds):
        total = np.bincount(subject, counts, k)
        prior = (np.bincount(subject, post * counts, k) + 0.5) / (total + 1)
        tables = []
        for j, (name, size) in enumerate(_KINDS.items()):
            t = np.stack([np.bincount(x[:, j], w * counts, size) for w in (post, 1 - post)]) + 0.5
            if size == 3:
                t[:, 0] = 0
            tables.append(_no_worse(t / t.sum(1, keepdims=True), name))
        new = _posterior(subject, x, prior, tables)
        settled = np.abs(new - post).max(initial=0) < 1e-6
        post = new
        if settled:
            break
    return prior, tables


def _no_worse(t: np.ndarray, name: str) -> np.ndarray:
    """Votes further up never speak less for the subject: neighbouring votes that do share their odds."""
    first = 0 if name == "lexicon" or t.shape[1] == 2 else 1
    groups = [[i] for i in range(first, t.shape[1])]
    odds = lambda g: t[0, g].sum() / t[1, g].sum()
    i = 0
    while i + 1 < len(groups):
        if odds(groups[i]) > odds(groups[i + 1]):
            groups[i : i + 2] = [groups[i] + groups[i + 1]]
            i = max(i - 1, 0)
        else:
            i += 1
    out = t.copy()
    for g in groups:
        out[0, g] = t[1, g] * odds(g)
    return out


def _posterior(subject: np.ndarray, x: np.ndarray, prior: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    odds = np.log(prior[subject]) - np.log(1 - prior[subject])
    for j in range(x.shape[1]):
        v, t = x[:, j], tables[j]
        said = np.ones(len(v), bool) if j == 0 else v > 0
        odds = odds + np.where(said, np.log(np.where(said, t[0][v], 1)) - np.log(np.where(said, t[1][v], 1)), 0)
    return 1 / (1 + np.exp(np.clip(-odds, -500, 500)))


def posteriors(patterns: list[tuple[int, ...]], k: int) -> list[tuple]:
    """(s, lexicon, section, address, source, posterior) of the patterns that have a cue vote, from the numbers of all:
    (s, lexicon, section, address, source, annotator, n), at most 270 a subject.

    The annotators are one function more, whose vote is 0 (no vote) on documents without labels, and on those beyond
    LABELLED_SAMPLE. The posteriors leave the annotators' votes out.
    """
    if not patterns:
        return []
    p = np.array(patterns)
    prior, tables = learn_accuracies(p[:, 0], p[:, 1:-1], p[:, -1].astype(float), k)
    found = np.unique(p[p[:, 1] > 0][:, :5], axis=0)
    post = _posterior(found[:, 0], found[:, 1:], prior, tables[:-1])
    return [(*map(int, r), float(q)) for r, q in zip(found, post, strict=True)]


def document_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, subject, posterior) with a posterior of at least `least`.

    Documents without a spoken cue (null, empty, blank texts, only adverts) have no row, and no document has a subject that
    none of its cues is about. Without labels only the descriptions teach; without words in them that the documents use,
    no row results. `subjects` is the fixed list of subjects, with an optional `description`.
    """
    spark = documents.sparkSession
    about = F.col("description").cast("string") if "description" in subjects.columns else F.lit(None).cast("string")
    listed = sorted({(r[0], r[1]) for r in subjects.select("subject", about).where("subject IS NOT NULL").collect()}, key=lambda r: (r[0], r[1] or ""))
    names = sorted({n for n, _ in listed})
    k = len(names)
    if not k:
        return spark.createDataFrame([], "doc_id long, subject string, posterior double")
    described = described_terms([(n, " ".join(d or "" for m, d in listed if m == n)) for n in names])
    blocks = materialise(document_blocks(documents))
    found = sorted((r[0], list(r[1])) for r in label_weights(labels, names).collect())  # at most LABELLED_SAMPLE
    known = spark.sparkContext.broadcast((np.array([i for i, _ in found], np.int64), np.array([w for _, w in found], float).reshape(len(found), k)))
    terms = lexicon_terms(materialise(taught_terms(blocks, None, known, k)), described, k, PURE_SEED, ODDS_SEED)
    for _ in range(PASSES):
        terms = lexicon_terms(materialise(taught_terms(blocks, terms, known, k)), described, k, PURE, ODDS)
    voted = materialise(votes(blocks, terms, known, k))
    patterns = voted.where("doc_id IS NULL AND n IS NOT NULL").groupBy("source", "s", "lexicon", "section", "address", "annotator").agg(F.sum("n").alias("n"))
    said = materialise(source_votes(patterns))
    same = (F.col("source") == F.col("vs")) & (F.col("s") == F.col("vi"))
    joined = lambda df: df.join(said, same, "left").withColumn("from_source", F.coalesce("vote", F.lit(0)))
    counted = joined(patterns).groupBy("s", "lexicon", "section", "address", "from_source", "annotator").agg(F.sum("n")).collect()  # at most 270 a subject
    post = spark.createDataFrame(posteriors([tuple(r) for r in counted], k), "ps int, p_lexicon int, p_section int, p_address int, p_source int, posterior double")
    match = (F.col("s") == F.col("ps")) & (F.col("lexicon") == F.col("p_lexicon")) & (F.col("section") == F.col("p_section")) & (F.col("address") == F.col("p_address")) & (F.col("from_source") == F.col("p_source"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("s") + 1)
    return joined(voted.where("n IS NULL")).join(F.broadcast(post), match).where(F.col("posterior") >= least).select("doc_id", name.alias("subject"), "posterior")
