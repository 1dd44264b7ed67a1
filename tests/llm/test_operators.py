"""Counts, classifiers, pieces, URL filters, decontamination and the pipeline."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm.decontamination import contaminated, word_list
from tarn.llm.piece_viterbi import Encoder, decode_pieces, encode_pieces, read_model, MODEL
from tarn.llm import quality
from tarn.llm import toxicity as toxicity_module
from tarn.llm.quality import quality_scores
from tarn.llm.queries import URL_RULES, op2_token_counts
from tarn.llm.token_counts import PATTERN, RANKS, limit_table, read_ranks, token_count_table, token_lengths
from tarn.llm.toxicity import SEEN_IN, common_features, toxicity
from tarn.llm.url_cascade import Cascade, filter_urls
from tests.conftest import TESTDATA
from tests.llm.conftest import PASSAGE, TEXTS, words
from tests.llm.test_dedup import brute_near

FOLDER = f"{TESTDATA}/sf0.01"


def test_limits_match_brute_force(spark):
    lengths = [0, 3, 3, 5, 5000, 9000, 9000]
    histogram = spark.createDataFrame([(n,) for n in lengths], "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    for row in limit_table(histogram).collect():
        limit = row.context_limit
        assert row.n_docs == lengths.count(limit)
        assert row.docs_over == sum(n > limit for n in lengths)
        assert row.total_tokens == sum(lengths)
        assert row.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert row.share_within == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))


def test_token_counts_cover_every_row(docs_of):
    docs = docs_of(TEXTS)
    assert token_count_table(docs).agg(F.sum("n_docs")).first()[0] == len(TEXTS)
    assert token_count_table(docs_of([])).count() == 0


def test_long_white_space_is_cut_as_the_pattern_cuts_it(docs_of):
    encoder = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    spaces = [" " * 1500, "\n" * 2000, " \t\xa0\u2003\n" * 400, "\x1c" * 1200, " " * 1000 + "\n"]
    texts = [a + s + b + s for s in spaces for a in ("", "word", "it's ", "a 1") for b in ("", "next", "'s", "!x", "7", "\u200bz")]
    rows = {r.doc_id: r.n_tokens for r in token_lengths(docs_of(texts)).collect()}
    assert rows == {i: len(encoder.encode_ordinary(text)) for i, text in enumerate(texts)}
    huge = [" " * 1_000_000, "\n" * 2_000_000 + "x", "a" * 1_000_000, f"x{' ' * 5_000_000}y"]
    assert token_lengths(docs_of(huge)).filter("n_tokens > 0").count() == len(huge)


def test_token_counts_match_a_plain_encoder_on_the_table(spark):
    folder = f"{TESTDATA}/sf0.001"
    encoder = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    lengths = [len(encoder.encode_ordinary(text or "")) for text in texts]
    rows = {r.context_limit: r for r in op2_token_counts(spark, folder).collect()}
    assert {limit: r.n_docs for limit, r in rows.items()} == Counter(lengths)
    for limit, r in rows.items():
        assert r.docs_over == sum(n > limit for n in lengths) and r.total_tokens == sum(lengths)
        assert r.truncated_tokens == sum(min(n, limit) for n in lengths)


def test_pieces_round_trip(docs_of):
    texts = [*TEXTS, "a  b", " lead", "trail ", "x\n\n y", "▁mark▁", "\U0001f600 é\x00", "\n"]
    rows = decode_pieces(encode_pieces(docs_of(texts))).collect()
    assert [r.decoded for r in sorted(rows)] == [t or "" for t in texts]
    assert encode_pieces(docs_of([])).count() == 0


def test_best_path_matches_dynamic_programming():
    entries = read_model(MODEL)
    encoder = Encoder(entries)
    score = {piece.decode(): s for piece, s, kind in entries if kind == "piece"}
    for text in ("hello world of tokens", "  spaces", "straße é▁x", "theandther"):
        text = f" {text}"
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = best[end - 1] + encoder.uncovered
            for begin in range(end):
                if text[begin:end] in score:
                    best[end] = max(best[end], best[begin] + score[text[begin:end]])
        ids = encoder.path(text)
        total, pending = 0.0, b""
        for i in ids:
            piece, s, kind = entries[i]
            if kind == "piece":
                total += s
            else:
                pending += piece
        total += encoder.uncovered * len(pending.decode())
        assert total == pytest.approx(best[-1])


def brute_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [
        (len(rule), rule, action)
        for action, rule in URL_RULES
        if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[len(rule.split("/")[0]) :])
    ]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls_match_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://net", "http://net/", "HTTP://A.NET/x?q", "x://example.net/en/a#b", "http://notexample.net/en/",
        "http://example.net/eng", "http://a.example.com/de/1", "http://org/fr/", "a://b://c.net/", "http://.net/", "http://net?x/", "http://É.NET/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: tuple(r)[1:] for r in filter_urls(pages, URL_RULES).collect()}
    assert rows == {i: brute_url(u) for i, u in enumerate(urls)}
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert filter_urls(pages, []).filter("rule is not null").count() == 0


def test_cascade_is_exact_over_its_corpus(spark):
    corpus = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    cascade = Cascade.build(corpus.filter("cast(key as long) % 97 = 3"), corpus)
    assert len(cascade.levels) > 1
    wrong = corpus.filter(cascade.lists(F.col("key")) != (F.col("key").cast("long") % 97 == 3))
    assert wrong.count() == 0


def test_decontamination_finds_items_wherever_they_lie(spark, docs_of):
    items = [(1, PASSAGE + "."), (2, words(20, "q") + ". " + words(8, "ans") + "."), (3, None), (4, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    lead = [words(n, "lead") + " " for n in (1, 59, 61, 500)]
    texts = [x + PASSAGE.upper() + " tail" for x in lead] + [words(80), None, "", words(20, "q") + " " + words(8, "ans")]
    for index_items in (1024, 1):
        rows = contaminated(docs_of(texts), benchmark, index_items=index_items).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == {(0, 1), (1, 1), (2, 1), (3, 1), (7, 2)}
    assert contaminated(docs_of([]), benchmark).count() == 0
    assert contaminated(docs_of(texts), benchmark.limit(0)).count() == 0


def test_decontamination_does_not_depend_on_how_the_benchmark_is_cut(spark, docs_of):
    """Partly copied items about the threshold, items of differing lengths, repeated rows."""
    pick = np.random.default_rng(3)
    items = [(i, " ".join(f"t{int(w)}" for w in pick.zipf(1.3, 12 + i % 40) % 300)) for i in range(60)]
    benchmark = spark.createDataFrame([*items, items[7], items[7], (None, items[9][1])], "item_id long, text string")
    texts = []
    for _, text in items:
        for share in (0.5, 0.6, 0.7, 0.8):
            found = text.split()
            cut = int(share * len(found))
            texts.append(" ".join(found[:cut] + [f"o{k}" for k in range(len(found) - cut)]))
    texts += [text for _, text in items]
    docs = docs_of(texts)
    find = lambda n: sorted((tuple(r) for r in contaminated(docs, benchmark, question=0.1, answer=0, index_items=n).collect()), key=repr)
    whole = find(1024)
    assert Counter(r[1] for r in whole if r[0] == 247)[7] == 3
    assert any(r[3] < 0.9 for r in whole)
    for index_items in (30, 7):
        assert find(index_items) == whole


def test_decontamination_matches_whole_items_on_the_table(spark):
    docs, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    joined = lambda text: b" " + b" ".join(word_list(text)) + b" "
    items = [(r.item_id, joined(r.text)) for r in benchmark.collect()]
    expected = {(d.doc_id, i) for d in docs.collect() for t in [joined(d.text)] for i, item in items if item in t}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()} == expected


def test_toxicity_finds_abuse_in_unlabelled_documents(spark, docs_of):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic long")
    texts = [f"you {'stupid worthless idiot' if i % 2 else 'kind gentle reader'} {i}" for i in range(80)] + [None, ""]
    rows = {r.doc_id: r for r in toxicity(docs_of(texts), labels).collect()}
    assert len(rows) == 82
    assert all(rows[i].toxic == bool(i % 2) for i in range(60, 80))
    assert not any(r.toxic for r in toxicity(docs_of(texts), labels.limit(0)).collect())
    assert toxicity(docs_of([]), labels).count() == 0


def test_chain_over_three_label_columns(spark, docs_of):
    """Each model is fed the earlier categories; a null label counts for the others only."""
    rude, threat = (lambda i: i % 2 == 0), (lambda i: i % 3 == 0)
    text = lambda i: f"{'stupid' if rude(i) else 'kind'} {'beware' if threat(i) else 'gentle'} reader {i % 7}"
    mark = lambda i, k: None if i % 11 == k else int((rude(i), threat(i), rude(i) and threat(i))[k])
    labels = spark.createDataFrame([(i, *(mark(i, k) for k in range(3))) for i in range(240)], "doc_id long, rude int, threat int, both int")
    docs = docs_of([text(i) for i in range(300)] + [None])
    seen = []
    chain = toxicity_module.fit_chain
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity_module, "fit_chain", lambda *a: seen.append(chain(*a)) or seen[0])
        rows = {r.doc_id: r for r in toxicity(docs, labels, categories=("rude", "threat", "both")).collect()}
    assert [len(model.earlier) for model in seen[0]] == [0, 1, 2]
    assert (seen[0][2].earlier > 0).all()
    for i in range(240, 300):
        assert ((rows[i].p_rude > 0.5), (rows[i].p_threat > 0.5), rows[i].toxic) == (rude(i), threat(i), rude(i) and threat(i))
    assert len(rows) == 301


def test_probabilities_are_those_of_the_models(spark, docs_of):
    """Scores of a table against a plain loop over its words with the fitted weights."""
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 4 < 2)) for i in range(80)], "doc_id long, toxic int, quality int")
    texts = [f"{'Stupidly worthless' if i % 2 else 'kind'} {'neat' if i % 4 < 2 else 'odd'} text {'x' * (i % 5)}" for i in range(90)] + ["", None]
    seen = []
    chain = toxicity_module.fit_chain
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity_module, "fit_chain", lambda *a: seen.append(chain(*a)) or seen[0])
        rows = {r.doc_id: r for r in toxicity(docs_of(texts), labels, categories=("quality", "toxic")).collect()}
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), np.uint8)
        features = set(toxicity_module.word_features(data, np.array([0, len(data)]))[1].tolist()) if len(data) else set()
        earlier = []
        for model in seen[0]:
            odds = model.constant + sum(w * p for w, p in zip(model.earlier, earlier, strict=True))
            odds += sum(w for h, w in zip(model.hashes.tolist(), model.weights, strict=True) if h in features)
            earlier.append(1 / (1 + np.exp(-odds)))
        assert (rows[i].p_quality, rows[i].p_toxic) == pytest.approx(earlier)


def test_a_repeated_labelled_id_adds_one_row(spark, monkeypatch):
    """One labelled id in 3,000 rows: what comes to the driver stays within the sample."""
    rows = [(1, f"stupid row {i}") for i in range(3_000)] + [(i, f"{'stupid' if i % 2 else 'kind'} text") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 40)], "doc_id long, toxic long, quality long")
    sizes = []
    chain, additive = toxicity_module.fit_chain, quality.fit
    monkeypatch.setattr(toxicity_module, "fit_chain", lambda texts, found: sizes.append(len(texts)) or chain(texts, found))
    monkeypatch.setattr(quality, "fit", lambda model, good, *rest: sizes.append(len(good)) or additive(model, good, *rest))
    assert toxicity(docs, labels).count() == len(rows)
    assert quality_scores(docs, labels).count() == len(rows)
    assert max(sizes) <= 39


def test_toxicity_learns_from_12000_labelled_rows(spark):
    """A form in five labelled texts only, all of them after the first 6,000 of the sample."""
    ids = [r[0] for r in spark.range(9_000).orderBy(F.xxhash64("id"), "id").collect()]
    rare = set(ids[6_000:6_005])
    labels = spark.createDataFrame([(i, int(i % 2 == 0 or i in rare)) for i in ids], "doc_id long, toxic long")
    text = lambda i: "zzqual person" if i in rare else "stupid person" if i % 2 == 0 else "kind person"
    docs = spark.createDataFrame([(i, text(i)) for i in ids] + [(9_000, "zzqual"), (9_001, "kind")], "doc_id long, text string")
    rows = {r.doc_id: r.toxic for r in toxicity(docs, labels).filter("doc_id >= 9000").collect()}
    assert rows == {9_000: True, 9_001: False}


def test_features_of_the_sample_are_counted_whole(spark):
    sets = [np.unique(np.arange(i % 7, 40, dtype=np.uint64) * np.uint64(i % 5 + 2**62)) for i in range(20)]
    known = spark.createDataFrame([(s.tobytes(),) for s in sets], "features binary").repartition(6)
    counts = Counter(int(x) for s in sets for x in s)
    assert common_features(known).tolist() == sorted(x for x, n in counts.items() if n >= SEEN_IN)


def test_quality_on_held_out_labels(spark, docs_of):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = Counter(r.predicted == r.quality for r in rows)
    assert right[True] > 0.85 * len(rows)
    empty = quality_scores(docs_of(["", None]), labels.limit(0)).collect()
    assert [r.score for r in empty] == [0.5, 0.5]


def test_quality_slopes_are_those_of_all_documents(spark):
    """Against a plain sum over the rows, dealt over several tasks."""
    pick = np.random.default_rng(3)
    rows = pick.normal(size=(3_000, len(quality.MEASURES)))
    model = quality.Additive.over([np.unique(np.quantile(c, [0.2, 0.5, 0.9])) for c in rows.T])
    weights = pick.normal(size=len(model.weights))
    table = spark.createDataFrame([(i % 3 == 0, *map(float, r)) for i, r in enumerate(rows)], ["half", *quality.MEASURES])
    blocks = quality.place_blocks(table.repartition(7), model)
    for part, use in ((blocks, rows), (blocks.filter("half"), rows[::3]), (blocks.filter("half is null"), rows[:0])):
        slopes, mean = np.zeros(len(weights)), 0.0
        for places in model.indicators(use) if len(use) else ():
            score = 1 / (1 + np.exp(-weights[places].sum() - weights[-1]))
            for place in (*places, -1):
                slopes[place] += score * (1 - score) / len(use)
            mean += score / len(use)
        found, score = quality.mean_slopes(part, weights)
        assert found == pytest.approx(slopes, abs=1e-6) and score == pytest.approx(mean, abs=1e-6)


def test_quality_learns_from_all_documents(docs_of, monkeypatch):
    """One text in fifty is good, and few positives are sampled."""
    pick = np.random.default_rng(5)
    good = lambda: " ".join(pick.choice(["plain", "words", "of", "a", "calm", "text"], 30)) + "."
    junk = lambda: " ".join(pick.choice(["$$$", "BUY", "@@", "99", "NOW!"], 30))
    docs = docs_of([good() if i % 50 == 0 else junk() for i in range(4_000)])
    labels = docs.filter("doc_id % 50 = 0").selectExpr("doc_id", "1 AS quality")
    priors, edges = [], []
    whole, cut = quality.estimate_prior, quality.quantile_edges
    monkeypatch.setattr(quality, "estimate_prior", lambda *a: priors.append(whole(*a)) or priors[0])
    monkeypatch.setattr(quality, "quantile_edges", lambda d: edges.append((cut(d), d.toPandas())) or edges[0][0])
    rows = quality_scores(docs, labels, sample_rows=30).collect()
    assert 0.01 < priors[0] < 0.03
    assert len(edges[0][1]) > 2_900
    for name, found in zip(quality.MEASURES, edges[0][0], strict=True):
        exact = np.quantile(edges[0][1][name], quality.QUANTILES, method="inverted_cdf")
        assert found == pytest.approx(np.unique(found[np.searchsorted(found, exact)]))
        assert all(np.min(np.abs(found - x)) <= 0.001 * x + quality.LEAST * 1.001 for x in exact)
    assert len(rows) == 4_000
    assert min(r.score for r in rows if r.doc_id % 50 == 0) > max(r.score for r in rows if r.doc_id % 50)
    assert all(r.predicted == (r.doc_id % 50 == 0) for r in rows)
    assert all(r.predicted == (r.doc_id % 50 == 0) for r in quality_scores(docs, labels).collect())


def test_pipeline_keeps_clean_documents_and_columns(spark):
    folder = f"{TESTDATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        assert 0.5 * docs.count() < kept.count() <= docs.count()
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() == docs.count()
    assert {r.doc_id for r in whole.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert whole.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and whole.filter("not round_trip").isEmpty()


def test_pipeline_stages_match_brute_force(spark, docs_of):
    """On planted documents and on the table: whom the stages after the first reject."""
    folder = f"{TESTDATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    joined = lambda text: b" " + b" ".join(word_list(text or "")) + b" "
    stages = dict(corpus_pipeline.STAGES)
    kept_by = lambda name, table: {r.doc_id for r in stages[name](spark, table, folder).select("doc_id").collect()}
    rows = docs.collect()

    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
    assert kept_by("exact_dedup", docs) == {min(group)[1] for group in groups.values()}

    near = brute_near([(r.doc_id, (r.text or "").encode()) for r in sorted(rows)], 5)
    assert kept_by("near_dedup", docs) == {doc for doc, (_, _, kept) in near.items() if kept}

    planted = spark.createDataFrame([*rows, (10_000, f"Lead in. {benchmark[0]} And on.", "en", "x", 1)], docs.schema)
    held = {r.doc_id for r in planted.collect() for item in benchmark if joined(item) in joined(r.text)}
    assert 10_000 in held
    assert kept_by("decontamination", planted) == {r.doc_id for r in planted.collect()} - held


def test_pipeline_drops_planted_toxic_texts_and_keeps_clean_ones(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    ids = {r.doc_id: r.toxic for r in labels.collect()}
    known = [r for r in sorted(docs.collect()) if r.doc_id in ids]
    toxic, clean = ([r for r in known if ids[r.doc_id] == k][:10] for k in (1, 0))
    planted = [(100_000 + i, *r[1:]) for i, r in enumerate(toxic + clean)]
    table = spark.createDataFrame([*docs.collect(), *planted], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, table, FOLDER).filter("doc_id >= 100000").collect()}
    assert len(toxic) == len(clean) == 10
    assert kept == {100_000 + i for i in range(10, 20)}
