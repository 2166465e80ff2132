import random

import numpy as np
import pyarrow as pa

from millrace.llm.subjects import Block, _Builder, _posterior, described_terms, document_subjects, learn_accuracies, posteriors
from millrace.llm.subtitles import cues, folded, hosts, repaired, spoken_words

WORDS = {"law": ["judge", "verdict", "witness", "appeal", "bench"], "sport": ["goal", "referee", "tackle", "league", "bench"], "music": ["violin", "chorus", "melody", "tempo"]}
TALK = ["Come in.", "Why are you smiling?", "It is late.", "Wait for me!", "I don't know.", "Nothing. Never mind."]
FRAMES = ["Nobody saw the {}.", "Where is the {}?", "First the {}, then tea.", "I dreamt of a {} again."]


def srt(lines, sep="\n"):
    return (sep * 2).join(f"{i}{sep}00:00:{i % 60:02},000 --> 00:00:{i % 60:02},900{sep}{x}" for i, x in enumerate(lines, 1))


def corpus(n, seed):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        about = r.sample(sorted(WORDS), r.choice([0, 1, 1, 2]))
        size = r.randrange(10, 25)
        lines = []
        for s in about:
            lines += [r.choice(FRAMES).format(r.choice(WORDS[s])) for _ in range(size // 3)]
        lines += [r.choice(TALK) for _ in range(size - len(lines))]
        if r.random() < 0.3:
            lines[-1] = r.choice(FRAMES).format(r.choice(WORDS[r.choice(sorted(WORDS))][:4]))
        r.shuffle(lines)
        docs.append((i, srt(lines, r.choice(["\n", "\r\n"])), r.choice(["s1", "s2", None])))
        truth[i] = set(about)
    return docs, truth


def test_held_out_documents(spark):
    docs, truth = corpus(500, 1)
    r = random.Random(2)
    labels = []
    for i in range(150):
        given = set(truth[i]) if r.random() > 0.08 else {r.choice(sorted(WORDS))}
        labels += [(i, s, "x", None) for s in given or {"none"}]
    docs += [(9001, None, "s1"), (9002, "", "s1"), (9003, " \n", None), (9004, srt(["[APPLAUSE]", "Subtitles by judgeTeam"]), "s1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    subjects = spark.createDataFrame([(s, "d") for s in WORDS], "subject string, description string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labelled_by string, labelled_at timestamp_ntz")
    got = {}
    for x in document_subjects(df, subjects, lab).collect():
        assert x["posterior"] >= 0.5
        got.setdefault(x["doc_id"], set()).add(x["subject"])
    tp = sum(len(truth[i] & got.get(i, set())) for i in range(150, 500))
    fp = sum(len(got.get(i, set()) - truth[i]) for i in range(150, 500))
    fn = sum(len(truth[i] - got.get(i, set())) for i in range(150, 500))
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95
    assert not set(got) & {9001, 9002, 9003, 9004}
    assert document_subjects(df, subjects, lab.limit(0)).count() == 0
    assert document_subjects(df.limit(0), subjects, lab).count() == 0


def test_rare_terms_count_in_a_large_corpus(spark):
    """A term of three documents is learned among 61,000 as it is among few."""
    common = [(i, srt([f"the {WORDS['law'][i % 4]}", "a day"] * 2 if i % 4 < 2 else ["come in", "it is late"]), "s1") for i in range(61_000)]
    mixed = [(i, srt(["the judge", "my gavel"] * 20), "s1") for i in (70_000, 70_001)]
    df = spark.createDataFrame([*common, *mixed, (70_002, srt(["my gavel"] * 6), "s1")], "doc_id long, text string, source string")
    subjects = spark.createDataFrame([("law", "d"), ("sport", "d")], "subject string, description string")
    labels = spark.createDataFrame([(i, "law" if i % 4 < 2 else "none", "x", None) for i in range(200)], "doc_id long, subject string, labelled_by string, labelled_at timestamp_ntz")
    got = {(x[0], x[1]) for x in document_subjects(df, subjects, labels).where("doc_id >= 70000").collect()}
    assert got == {(70_000, "law"), (70_001, "law"), (70_002, "law")}


def test_accuracies_are_learned():
    r = np.random.default_rng(3)
    n = 4000
    truth = r.random(n) < 0.3
    x = np.stack([np.where(truth ^ (r.random(n) < 0.03), 4, 0), 1 + np.where(truth, r.random(n) < 0.8, r.random(n) < 0.05), np.zeros(n), np.zeros(n), np.where(truth ^ (r.random(n) < 0.15), 2, 1)], 1).astype(int)
    prior, tables = learn_accuracies(np.zeros(n, int), x, np.ones(n), 1)
    assert abs(prior[0] - 0.3) < 0.03 and abs(tables[4][0][2] - 0.85) < 0.03 and abs(tables[1][1][2] - 0.05) < 0.02


def test_no_function_is_worse_than_chance():
    """Addresses that name the wrong subjects, and annotators who say the contrary, don't turn into evidence."""
    r = np.random.default_rng(4)
    truth = r.random(4000) < 0.3
    x = np.stack([np.where(truth, 4, 0), np.where(truth, 2, 1), np.where(truth, 0, r.random(4000) < 0.5), np.zeros(4000), np.where(truth, 1, 2)], 1).astype(int)
    _, tables = learn_accuracies(np.zeros(4000, int), x, np.ones(4000), 1)
    assert tables[2][0][1] >= tables[2][1][1] - 1e-9 and tables[4][0][2] >= tables[4][1][2] - 1e-9
    odds = tables[0][0] / tables[0][1]
    assert (np.diff(odds) >= -1e-9).all()


def test_priors_are_those_of_all_documents():
    """Annotators saw mostly documents with the subject, which is rare."""
    patterns = [(0, 4, 0, 0, 0, 2, 90), (0, 2, 0, 0, 0, 2, 8), (0, 2, 0, 0, 0, 1, 2), (0, 0, 0, 0, 0, 1, 20), (0, 0, 0, 0, 0, 0, 5000), (0, 4, 0, 0, 0, 0, 50), (0, 2, 0, 0, 0, 0, 20)]
    p = np.array(patterns)
    prior, _ = learn_accuracies(p[:, 0], p[:, 1:-1], p[:, -1].astype(float), 1)
    assert 0.02 < prior[0] < 0.04
    post = {r[1]: r[-1] for r in posteriors(patterns, 1)}
    assert post[4] > 0.9 and set(post) == {2, 4}


def test_no_vote_is_no_evidence():
    """However telling it is that a function votes, that it doesn't vote tells nothing."""
    lexicon = np.array([[0.1, 0.1, 0.1, 0.1, 0.6], [0.6, 0.1, 0.1, 0.1, 0.1]])
    telling = [np.array([[0, 0.1, 0.9], [0, 0.9, 0.1]]), np.array([[0.05, 0.95], [0.95, 0.05]]), np.array([[0, 0.1, 0.9], [0, 0.9, 0.1]])]
    x = np.array([[4, 0, 0, 0], [1, 0, 0, 0], [1, 2, 0, 0], [1, 0, 1, 0], [1, 0, 0, 1]])
    got = _posterior(np.zeros(5, int), x, np.array([0.5]), [lexicon, *telling])
    np.testing.assert_allclose(got, [6 / 7, 0.5, 0.9, 0.95, 0.1])


def block(docs, lang="en"):
    b = _Builder()
    for i, d in enumerate(docs):
        b.add(i, "s", lang, srt(d))
    return Block.of(pa.Table.from_batches([b.row(0)])), b.index


def test_ambiguous_terms_follow_the_document():
    got, at = block([["the judge", "a bench"], ["a goal", "a bench"], ["a bench"], []])
    by = got.about({at[folded("judge")]: [0], at[folded("goal")]: [1], at[folded("bench")]: [0, 1]}, 2).sum(1)
    assert by.tolist() == [[2, 0], [0, 2], [0, 0], [0, 0]]


def test_cues_are_counted_by_thirds():
    got, at = block([["the judge judge"] * 2 + ["tea"] * 4, ["tea", "tea", "the goal"]])
    by = got.about({at[folded("judge")]: [0], at[folded("goal")]: [1]}, 2)
    assert by[0, :, 0].tolist() == [2, 0, 0] and by[1, :, 1].tolist() == [0, 0, 1] and by.sum() == 3


def test_without_a_cue_no_subject(spark):
    """A source in which all else is about law, and annotators who say law, don't give a document the subject."""
    docs, truth = [], {}
    r = random.Random(7)
    for i in range(240):
        law = i % 2 == 0
        lines = [r.choice(FRAMES).format(r.choice(WORDS["law"])) for _ in range(6 * law)] + [r.choice(TALK) for _ in range(8)]
        docs.append((i, srt(lines), "court" if law else "street"))
    docs += [(i, srt([r.choice(TALK) for _ in range(10)]), "court") for i in range(300, 304)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels = [(i, "law" if i % 2 == 0 else "none", "x") for i in range(80)] + [(i, "law", "x") for i in range(300, 304)]
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labelled_by string")
    got = {x[0] for x in document_subjects(df, spark.createDataFrame([("law",), ("sport",)], "subject string"), lab).collect()}
    assert got == set(range(0, 240, 2))


def test_small_talk_of_a_language_with_few_labels(spark):
    """Two labelled documents of a language, both of one subject: what all its documents say isn't about it."""
    r = random.Random(5)
    talk = ["Komm herein.", "Warum lachst du?", "Es wird langsam dunkel.", "Warte auf mich!", "Morgen vielleicht."]
    words = ["Richter", "Urteil", "Zeuge", "Berufung"]
    docs = [(i, srt([r.choice(FRAMES).format(r.choice(WORDS[s])) for s in ["law", "sport", "music"][i % 3 : i % 3 + 1] for _ in range(6)] + [r.choice(TALK) for _ in range(6)]), "en") for i in range(200)]
    docs += [(i, srt([r.choice(["Der {} war da.", "Wo ist der {}?"]).format(r.choice(words)) for _ in range(6 * (i % 4 == 0))] + [r.choice(talk) for _ in range(8)]), "de") for i in range(1000, 1080)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = [(i, ["law", "sport", "music"][i % 3], "x") for i in range(40)] + [(1000, "law", "x"), (1004, "law", "x")]
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labelled_by string")
    got = {(x[0], x[1]) for x in document_subjects(df, spark.createDataFrame([(s,) for s in WORDS], "subject string"), lab).where("doc_id >= 1000").collect()}
    assert {s for _, s in got} == {"law"} and {d for d, _ in got} == set(range(1000, 1080, 4))


def test_descriptions_teach():
    assert described_terms([("law", "Courts, judges"), ("sport", "Games, courts")]) == sorted([(folded("law"), 0), (folded("judges"), 0), (folded("judge"), 0), (folded("sport"), 1), (folded("games"), 1), (folded("game"), 1)])


def test_cues_of_all_forms():
    assert cues("﻿WEBVTT\r\n\r\nNOTE x\r\ny\r\n\r\n00:01.000 --> 00:02.000\r\nHi\r\nthere\r\n\r\n2\r\n0O:02,0 --> 00:03\r\nBye") == ["Hi\nthere", "Bye"]
    assert cues(None) == cues("") == cues("no cue") == []
    assert spoken_words("[door slams]") is None and spoken_words("♪ la la ♪") is None and spoken_words("Visit abc.example for more") is None
    assert spoken_words("<i>JOHN: - The end.</i>") == folded("The end")
    assert folded("config fiIe") == folded("config file") and folded("ancl") == folded("and") and folded("rnatter") == folded("matter")
    assert repaired("dÃ©claration") == "déclaration" and hosts("see www.judge.example now") >= {folded("judge")}


def test_long_addresses_are_read_from_their_start():
    assert hosts("see judge-" + "ab-" * 60 + "cd.example now") >= {folded("judge"), folded("ab"), folded("example")}
    assert hosts("www.judge.example and goal.example") == {folded(w) for w in ("www", "judge", "example", "goal")}


def test_odd_inputs(spark):
    """Only null texts, quotes in a subject's name, clashing columns, null ids and labels."""
    subjects = spark.createDataFrame([("rock'n \\roll", "Songs, drums"), ("law", None), (None, "x")], "subject string, description string")
    labels = spark.createDataFrame([(1, " Rock'N \\Roll", "x"), (None, "law", "x"), (2, None, "x"), (3, "rock'n \\roll", None)], "doc_id long, subject string, labelled_by string")
    none = spark.createDataFrame([(1, None), (2, None), (None, "")], "doc_id long, text string")
    assert document_subjects(none, subjects, labels).count() == 0
    songs = srt(["the drums", "a drums solo", "loud drums", "come in"])
    docs = spark.createDataFrame([(i, songs if i in (1, 2, 3, 4) else srt(["come in", "it is late"]), 7, "t", None) for i in [*range(1, 9), None]], "doc_id long, text string, block int, term string, lang string")
    got = {(r[0], r[1]) for r in document_subjects(docs, subjects, labels).collect()}
    assert got == {(i, "rock'n \\roll") for i in range(1, 5)}
    assert document_subjects(docs, subjects.limit(0), labels).count() == 0
