"""Rules that only show on larger tables: long chains, halves and ties."""

import gc
import hashlib
import math
import random

import pyarrow as pa

from studyloom.operators import chunks, concepts, extraction, graph, learner, material, near_names, phrases, planning, repair, retrieval, search, structure, text


def test_a_chain_of_as_many_nodes_as_levels_goes_on(spark):
    """A plain line has one new node a level, so at a look for cycles it has as many nodes as levels."""
    n = 2 * graph.CHECK_LEVELS + 5
    edges = spark.createDataFrame([(i, i, i - 1, "REQUIRES", 1.0) for i in range(1, n + 1)], "edge_id long, source_id long, target_id long, relation string, confidence double")
    got = graph.prerequisite_chain(edges, spark.createDataFrame([(n,)], "concept_id long")).orderBy("place").collect()
    assert [(r.node, r.distance) for r in got] == [(i, n - i) for i in range(n)]


def test_halves_go_up_whatever_the_order_of_the_sum(spark):
    """A mean of exactly 12.5, which in this order of doubles sums to 12.499999999999998."""
    rows = [("a", 1, 6), ("a", 1, 3), ("a", 0, 3), ("a", 0, 7)]
    attempts = spark.createDataFrame(rows, "quiz_id string, correct long, total long").coalesce(1)
    assert learner.quiz_progress(attempts).first().average == 13


def test_equal_priorities_and_titles_go_by_state(spark):
    """.7 missing and .9 partial both have the priority .945."""
    rows = [(i, "same", s, x, False) for i in range(40) for s, x in ((("missing", 0.7), ("partial", 0.9)) if i % 2 else (("partial", 0.9), ("missing", 0.7)))]
    got = material.review_priority(spark.createDataFrame(rows, "lecture_id long, title string, state string, importance double, visual boolean")).where("rank = 1")
    assert {r.state for r in got.collect()} == {"missing"}


def test_half_a_percent_goes_up(spark):
    items = spark.createDataFrame([(1, "covered", False)], "lecture_id long, state string, visual boolean")
    share = spark.createDataFrame([(1, 0.53499999999999992)], "lecture_id long, completeness double")
    assert material.coverage_report(items, share).first().summary.startswith("54%")


def test_names_meet_by_rare_terms_only(spark):
    """Names that begin alike but are not similar hardly meet; those with one word changed do."""
    rows = [(i, f"the part of the {i} and {i + 1000} with {i + 2000} in {i + 3000}") for i in range(200)] + [(900 + i, f"the part of the {i} and {i + 1000} with {i + 2000} in the {i + 3000}") for i in range(5)]
    names = spark.createDataFrame(rows, "rep long, name string")
    heads = near_names.rare_terms(names.select("rep", near_names.weighted_terms(names.name).alias("terms")), 0.8)
    met = heads.join(heads.withColumnRenamed("rep", "b"), "t").where("rep < b").select("rep", "b").distinct().count()
    pairs = near_names.near_duplicates(names.withColumnRenamed("rep", "concept_id"), 0.8)[1].collect()
    assert {(r.a, r.b) for r in pairs} == {(i, 900 + i) for i in range(5)} and met < 50


def test_an_acronym_has_one_letter_a_word(spark):
    """A word that begins with a sharp s, in capitals SS, still gives one letter."""
    concepts = spark.createDataFrame([(1, "x", "Alpha ßein Gamma"), (2, "y", "ŉa Beta")], "doc_id long, key string, term string")
    got = {r.doc_id: r.a for r in concepts.select("doc_id", extraction.acronym(concepts.term).alias("a")).collect()}
    assert got == {1: "AẞG", 2: "ŉB"}


def test_vectors_meet_in_blocks_and_no_pair_is_a_row(spark):
    """Copies go by id; vectors with nulls, zeros or another length keep their places."""
    rows = [(i, [1.0, 2.0, float(i // 3)]) for i in range(12)] + [(20, [0.0, 0.0, 0.0]), (21, None), (22, [1.0, None, 2.0]), (23, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = search.cosine_top(df.where("vec_id in (0, 20)"), df, 14)
    assert "Join" not in top._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.rank): (r.vec_id, r.score is None) for r in top.collect()}
    assert [got[0, i] for i in range(1, 15)] == [(i, False) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 20, 21, 22)]
    assert [got[20, i][0] for i in range(1, 15)] == [*range(12), 21, 22]


def test_phrases_are_found_in_the_source_s_row(spark):
    """Nothing is shuffled; equal scores by nine digits go by title, keys of other scripts and marks hold, null is no text."""
    rows = [(1, "k", "Bb cc, Aa aa\nzz Zeta9 ½́; Ünder-Grün + ٣", 1.0, False), (2, "k", None, 1.0, True), (3, "k", "Diagram of cells", 0.0, True)]
    found = phrases.phrases(spark.createDataFrame(rows, "source_id long, kind string, text string, weight double, visual boolean"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.source_id, r.rank): (r.key, r.title, r.importance, r.lines) for r in found.collect()}
    assert got[3, 1] == ("cells", "cells", 0.0, [0]) and got[3, 2] == ("diagram", "Diagram", 0.0, [0]) and not any(s == 2 for s, _ in got)
    assert {x[:2] for (s, _), x in got.items() if s == 1} == {("zeta9", "Zeta9"), ("ünder grün", "Ünder Grün")}


def test_candidates_are_found_in_the_document_s_row(spark):
    """Nothing is shuffled, the limit ends the search, and a sentence's key is made once for all names."""
    many = ". ".join(f"Cell Wall{i} is here" for i in range(30))
    rows = [(1, "Ülo Ärm: the A-B test, is x = 2. NASA\n# Head line\nüber"), (2, None), (3, many), (4, "  \n.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = extraction.candidate_concepts(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {d: [r.term for r in sorted(found.collect(), key=lambda r: r["rank"]) if r.doc_id == d] for d in (1, 2, 3, 4)}
    assert got == {1: ["Ülo Ärm", "Ülo Ärm: the A-B test,", "A-B", "# Head line"], 2: [], 3: [f"Cell Wall{i}" for i in range(18)], 4: []}
    plain = [r for r in ("is", "Xy", "ab-", "Cell", "٣٤", "general topic", "a b c d e f g h", "Zoë") if extraction.meaningful_key(r)]
    terms = spark.createDataFrame([(r,) for r in ("is", "Xy", "ab-", "Cell", "٣٤", "general topic", "a b c d e f g h", "Zoë")], "t string")
    assert plain == [r.t for r in terms.where(extraction.is_meaningful(terms.t)).collect()]


def test_gaps_read_the_notes_once(spark):
    """What a note has and lacks is kept, so that counting reads no note again."""
    notes = spark.createDataFrame([(1, "A Database with an INDEX"), (2, "a database"), (3, None), (4, "transaction")], "note_id long, text string")
    got = planning.mapped_gaps(notes, {"database": ("index", "transaction", "normalization")})
    assert "LocalTableScan" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" not in plan
    assert {(r.note_id, r.need, r.n_notes) for r in got.collect()} == {(1, "transaction", 1), (2, "index", 1), (2, "transaction", 1)}


def test_a_batch_of_texts_is_repaired_a_few_at_a_time():
    """However long a batch, no list holds more than a few of its texts as strings of Python."""
    batch, most = pa.array(["a\n\n\nb", None] * 500), []

    def made(text):
        if len(most) % 200 == 0:
            most.append(max((len(x) for x in gc.get_objects() if type(x) is list and len(x) > 8 and x[0] == "a\n\n\nb"), default=0))
        return repair.clean_text(text)

    out = repair._each(batch, made)
    assert out.to_pylist() == ["a\n\nb", None] * 500 and max(most) <= repair.TEXTS and repair._each(batch[:0], made).to_pylist() == []


def test_mentions_read_the_sentences_once(spark):
    """One reading for windows of all lengths, and a second one only where a name is longer than a window."""
    sentences = spark.createDataFrame([(1, 0, "The cell wall of plants"), (1, 1, ""), (2, 0, "walls"), (3, 0, "a b c d e f g h")], "doc_id long, pos int, sentence string")
    names = [("1", "wall"), ("2", "Cell walls"), ("3", "b c d e f g h")]
    for several in (names[:2], names):
        found = concepts.mentions(sentences, spark.createDataFrame(several, "concept_id string, name string"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == (1 if several is not names else 2)
        got = {(r.doc_id, r.pos, r.concept_id, r["at"]) for r in found.collect()}
        assert got == {(1, 0, "1", 2), (1, 0, "2", 1), (2, 0, "1", 0)} | ({(3, 0, "3", 1)} if several is names else set())


def test_blocks_are_found_in_the_document_s_row(spark):
    """No line is shuffled; fences, odd white space, numbers and ends of other scripts hold, and all rules of blocks read them once."""
    text = "# Ünder\n1.2) Bb\n ```py\n# no\n\n```\nx + y = z ?\r\na|b|c\n* i\n\x0b\n٣ kk\n1. low\nAa, b:\n#  "
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    blocks = structure.detect_blocks(df)
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
    kinds = ["heading-0-0", "heading-1-1", "codeBlock-2-5", "paragraph-6-6", "table-7-7", "bulletedList-8-8", "paragraph-9-10", "numberedList-11-11", "heading-12-12", "paragraph-13-13"]
    assert [r.block_id for r in blocks.orderBy("start_line").collect()] == kinds
    found = structure.validate_structure(blocks.unionByName(blocks), structure.section_tree(df))
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 2
    assert {(r.doc_id, r.rule, r.n) for r in found.collect()} == {(1, "repeated block", 10), (1, "overlapping blocks", 10)}


def test_chunks_are_found_in_the_document_s_row(spark):
    """A section over the budget is cut by paragraphs and lines, the next one is whole; nothing is shuffled."""
    words = lambda c, n: " ".join([c] * n)
    text = "\n".join([words("a", 50), "Bob: b", "", words("c", 70), words("d", 70), "# Two", " e "])
    df = spark.createDataFrame([(1, text), (2, None), (3, "# X")], "doc_id long, text string")
    got = chunks.semantic_chunks(df, 100)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = [(r.doc_id, r.section_line, r.first_line, r.last_line, r.content) for r in got.orderBy("doc_id", "chunk").collect()]
    long = [(1, -1, 3, 4, words("c", 70)), (1, -1, 3, 4, words("c", 70) + "\n" + words("d", 70))]
    assert rows == [(1, -1, 0, 1, words("a", 50) + "\n\nBob: b"), (1, -1, 1, 1, "Bob: b"), *long, (1, 5, 6, 6, "e"), (3, -1, 0, 0, "")]


def test_text_is_hashed_by_md5_in_its_row_as_by_a_plain_loop(spark):
    text = "Ünder grün; one, two two\n٣ one"
    words = "ünder grün one two two ٣ one".split()
    want = [0.0] * 16
    for t, v in [(w, 1.0) for w in words] + [(f"{a} {b}", 0.75) for a, b in zip(words, words[1:], strict=False)]:
        want[int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % 16] += v
    df = spark.createDataFrame([(1, text), (2, None), (3, "one")], "doc_id long, text string")
    made = retrieval.hashed_embedding(df, 16, "md5")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString() and "conv(" not in made._jdf.queryExecution().analyzed().toString()
    got = {r.doc_id: r.embedding for r in made.collect()}
    norm = math.sqrt(sum(x * x for x in want))
    assert all(abs(x - y / norm) < 1e-12 for x, y in zip(got[1], want, strict=True)) and not any(got[2]) and max(got[3]) == 1
    assert [round(r.similarity, 9) for r in retrieval.embedding_similarity(made, made).orderBy("doc_id").collect()] == [1, 0, 1]


def test_evidence_is_found_in_the_document_s_row(spark):
    """As the operator over sentences has it: by key, acronym, joined words, brackets and slashes; what no sentence names is its own evidence."""
    texts = [(1, "Alpha Beta is (aß one) here. The AB works. Nothing! So alpha-beta/Gamma Ray ends. Then Gamma Ray. aß one\nGamma ray ß"), (2, None), (3, "Straße Übung: x means y.\nSÜ (q) = z"), (4, "# Head Line\n")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = extraction.evidence_in_texts(df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    concepts, said = extraction.candidate_concepts(df), text.sentences(df)
    want = extraction.evidence(concepts, said, 2, extraction.aliases(concepts, said))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("doc_id = 1 and nth = 2").count()


def test_paths_are_sought_from_both_ends(spark):
    """A hub at the far end of a search isn't entered; lengths, ties and parallel edges are those of a plain search."""
    rng = random.Random(3)
    rows = [(i, *rng.sample(range(14), 2)) for i in range(18)] + [(100 + i, 50, 51 + i) for i in range(60)] + [(200, 0, 50), (201, 50, 0)]
    edges = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "edge_id long, source_id long, target_id long, relation string, confidence double")
    beside, ids = {}, {}
    for e, a, b in rows:
        for x, y in ((a, b), (b, a)):
            beside.setdefault(x, set()).add(y)
            ids[x, y] = min(e, ids.get((x, y), e))
    want = {}
    for a in (0, 3, 5):
        level, seen = {a: [a]}, {a}
        for _ in range(6):
            want |= {(a, b): p for b, p in level.items()}
            seen |= set(level)
            level = {y: min(p + [y] for x, p in level.items() if y in beside[x]) for y in {y for x in level for y in beside.get(x, ())} - seen}
    pairs = [(a, b) for a in (0, 3, 5) for b in (*range(14), 50, 60)]
    for depth in (1, 4, 5):
        got = graph.shortest_paths(edges, spark.createDataFrame([*pairs, (None, 1)], "source long, target long"), depth).collect()
        assert {(r.source, r.target): r.path for r in got} == {k: p for k, p in want.items() if k in pairs and len(p) <= depth + 1}
        assert all(r.edges == [ids[x] for x in zip(r.path, r.path[1:], strict=False)] and r.length == len(r.edges) for r in got)
    ends = spark.createDataFrame([(5,)], "end long")
    steps = graph._steps(edges, "both")
    assert graph._ball(steps, ends, 2, False).count() < graph._ball(steps, ends, 4, False).count()
