import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF, plan_of
from tests.llm.test_near_prints import brute_classes
from volscribe import session
from volscribe.llm import language, mixing, packing, queries
from volscribe.llm.common import text_buffer

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def checked_packing(rows, texts, tokenizer, capacity=4096):
    """Every document's tokens are there, once for each time it is in ``texts``, in sequences without gaps."""
    ids = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in texts}
    times, have, used = Counter(d for d, _ in texts), Counter(), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(own), r.start, zlib.crc32(own.tobytes())) == (r.length, capacity * r.piece, r.ids_crc32)
        assert r.length == min(capacity, len(ids[r.doc_id]) - r.start)
        have[r.doc_id, r.piece] += 1
        used[r.sequence_id].append((r.offset, r.length))
    assert have == Counter({(d, k): n for d, n in times.items() for k in range(-(-len(ids[d]) // capacity))})
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used), -(-sum(len(ids[d]) for d, _ in texts) // capacity)


def test_op7_round_trip(spark, texts, tokenizer):
    sequences, least = checked_packing(queries.QUERIES["op7_packing"](spark, SF).collect(), texts, tokenizer)
    assert sequences <= least + 1


def test_op7_odd(odd, nothing, tokenizer):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    checked_packing(packing.pack(odd, FILE).collect(), texts, tokenizer)
    assert packing.pack(nothing, FILE).count() == 0


def test_packing_leaves_no_encoder_in_the_workers(spark):
    def held(batches):
        import pyarrow as pa

        from volscribe.llm import packing

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packing._encoder.cache_info().currsize] * batch.num_rows)], ["encoders"])

    docs = spark.range(200, numPartitions=16).selectExpr("id AS doc_id", "concat('word ', id, ' and more') AS text")
    assert packing.pieces(docs, Path(FILE).read_text()).count() == 200
    assert spark.range(200, numPartitions=16).mapInArrow(held, "encoders bigint").agg({"encoders": "max"}).first()[0] == 0


pieces_of_text = st.text(alphabet="aB'st .,!é…1\u0301İΣσ\u2003\x1c\x01<|>", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces_of_text, min_size=1, max_size=4))
def test_words_encode_as_the_whole_text(texts):
    import pyarrow as pa

    encoder = packing._encoder(open(FILE).read())
    ids, at = encoder.encode(*text_buffer(pa.array(texts)))
    for text, low, high in zip(texts, at, at[1:], strict=False):
        assert ids[low:high].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fullest_equals_trying_all(available, room):
    sums = {0}
    for length, n in available.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    chosen = packing.fullest(available, room)
    assert sum(k * n for k, n in chosen.items()) == max(sums)
    assert all(0 < n <= available[k] for k, n in chosen.items())


def sizes(texts):
    return {d: len((t or "").split()) for d, t in texts}


def water_filled(source_sizes):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(source_sizes, key=lambda s: (s is None, s or "")))}
    left, out = dict(source_sizes), {}
    whole = 1.5 * sum(source_sizes.values())
    while left:
        rate = (whole - sum(out.values())) / sum(weights[s] for s in left)
        above = [s for s in left if weights[s] * rate > 2 * left[s]]
        if not above:
            return {**out, **{s: weights[s] * rate for s in left}}
        for s in above:
            out[s] = 2.0 * left.pop(s)
    return out


def test_op8_targets_and_takes(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = queries.QUERIES["op8_mixing"](spark, SF)
    got = df.collect()
    assert {r.doc_id for r in got} == docs.keys() and len(got) == len(docs)
    totals, takes = Counter(), Counter()
    for d in docs.values():
        totals[d.source] += len(d.text.split())
    want = water_filled(totals)
    longest = defaultdict(int)
    for r in got:
        source = docs[r.doc_id].source
        assert r.size == len(docs[r.doc_id].text.split()) and r.source_size == totals[source]
        assert r.target == pytest.approx(want[source]) and r.taken in (0, r.size, 2 * r.size)
        takes[source] += r.taken
        longest[source] = max(longest[source], r.size)
    for source, target in want.items():
        assert abs(takes[source] - target) <= max(0.02 * target, longest[source])
    assert sorted(map(repr, got)) == sorted(map(repr, df.collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, queries.QUERIES["op8_mixing"](spark, SF).collect()))


def test_op8_has_no_python_in_its_plan(spark):
    assert not any(word in plan_of(queries.QUERIES["op8_mixing"](spark, SF)) for word in ("Python", "Arrow", "Pandas"))


def test_op8_rounding_keeps_means_and_words(spark):
    """Over many seeds each document is taken as often as its chance says; words differ from the mean by one document."""
    rows = [("s", k, 1, 5 + 7 * k % 50, 0.3, 200) for k in range(200)]
    items = spark.createDataFrame(rows, "source string, doc_id long, copy int, size long, p double, n long")
    counts, words = Counter(), sum(r[3] for r in rows)
    for seed in range(0, 12):
        found = mixing.rounded_copies(items, 200, 1000 * seed).collect()
        assert len(found) == 200 and abs(sum(r["size"] * r["take"] for r in found) - 0.3 * words) < 55
        counts.update(r["doc_id"] for r in found if r["take"])
    assert abs(sum(counts.values()) / (12 * 200) - 0.3) < 0.04


def test_op8_odd(odd, nothing):
    got = mixing.mix(odd).collect()
    assert len(got) == 15 and sum(r.doc_id == 4 for r in got) == 2
    assert {r.source for r in got} == {"a", "b", "c", "z", "é", None}
    totals = Counter()
    for r in got:
        totals[r.source] += r["size"]
    want = water_filled(totals)
    assert all(r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(nothing).count() == 0
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    assert rows.count() == sum(r.copies for r in got)


def test_mixed_rows_of_ids_that_several_rows_share(spark):
    rows = [(1, "one two", "s", k) for k in range(3)] + [(1, "three", "s", 9), (None, "four five", None, 0), (2, "six", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    planned = Counter()
    for r in mixing.mix(docs).collect():
        planned[r.doc_id, r.source, r["size"]] += r.copies
    found = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mixed_rows(docs).collect())
    assert found == +planned


def test_mixed_rows_without_doc_ids(spark):
    """Many rows of one source and size without a doc_id: each copy that the mix takes is some row's, none twice as another's."""
    rows = [(None if k % 3 else k, f"word w{k % 200}", "s") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    planned = Counter((r.doc_id, r.copies) for r in mixing.mix(docs).collect() if r.copies)
    kept = Counter((r.doc_id, r.text) for r in mixing.mixed_rows(docs).collect())
    have = Counter((d, text) for d, text, _ in rows)
    assert sum(kept.values()) == sum(copies * n for (_, copies), n in planned.items())
    assert all(n <= 2 * have[row] for row, n in kept.items())
    assert sum(n for (d, _), n in kept.items() if d is None) == sum(copies * n for (d, copies), n in planned.items() if d is None)


def test_op10_accuracy_and_rules(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op10_language_id"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    held = [d for d in docs if zlib.crc32(str(d).encode()) % 3 == 1]
    assert {d for d, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[d].lang_pred == docs[d].lang for d in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_op10_predicts_from_the_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = language.fit_profiles(docs.where(~language.held_out()))
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, profiles).collect()}
    other = docs.selectExpr("doc_id + 7 AS doc_id", "text", "'xx' AS lang", "'s' AS source")
    assert {r.doc_id - 7: (r.lang_pred, r.score) for r in language.predict(other, profiles).collect()} == plain


def test_op10_odd(odd, nothing):
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert [got[d].lang_pred for d in (1, 2, 3, 7)] == ["und"] * 4 and got[1].score == 0.0
    assert got[9].lang_pred == "en" and got[None].held_out is False
    assert language.identify(nothing).count() == 0
    kept = language.accepted(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {4, 5, 6, 8, 9, 10, 11, 12, None, -5} - {
        d for d, r in got.items() if r.score < language.LEAST_SCORE
    }
    assert language.accepted(nothing).count() == 0
    # Without labels there is no language to predict, and nothing to reject texts by.
    bare = odd.withColumn("lang", odd.lang.substr(1, 0)).where("false").unionByName(odd.selectExpr("doc_id", "text", "cast(null AS string) AS lang", *odd.columns[3:]))
    assert {r.lang_pred for r in language.identify(bare).collect()} == {"und"}


def brute_sum(text, dimensions=language.DIMENSIONS, seed=7):
    """The sum over a text's letter triples, counted in a dictionary, of the product of their rotated vectors."""
    words = "".join(c if c.isalpha() else "\0" for c in text.lower())
    joined = "\0" + "\0".join(w for w in words.split("\0") if w) + "\0"
    triples = Counter(joined[k : k + 3] for k in range(len(joined) - 2)) if joined.strip("\0") else Counter()
    vectors = {c: np.random.default_rng([seed, ord(c)]).integers(0, 2, dimensions, dtype=np.int8).astype(int) * 2 - 1 for c in set("".join(triples))}
    return sum((n * np.roll(vectors[t[0]], 2) * np.roll(vectors[t[1]], 1) * vectors[t[2]] for t, n in triples.items()), np.zeros(dimensions))


def test_op10_equals_brute_force(spark):
    docs = [d for d in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(d.text or "") < 3000]
    frame = spark.createDataFrame([(d.doc_id, d.text, d.lang) for d in docs], "doc_id long, text string, lang string")
    sums = {d.doc_id: brute_sum(d.text or "") for d in docs}
    profiles = {}
    for d in docs:
        if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 3 != 1:
            profiles[d.lang] = profiles.get(d.lang, 0) + sums[d.doc_id]
    for r in language.identify(frame).collect():
        own = sums[r.doc_id]
        cosine = {n: own @ p / max(np.linalg.norm(own) * np.linalg.norm(p), 1e-9) for n, p in profiles.items()}
        want = max(sorted(cosine), key=cosine.__getitem__) if own.any() else "und"
        assert r.lang_pred == want and abs(r.score - max(0, max(cosine.values()) if own.any() else 0)) < 1e-4


def test_the_language_stage_rejects_what_is_in_no_language(spark):
    """Random letters and languages that no document is labelled with go; labelled documents stay."""
    docs = spark.read.parquet(f"{Path(SF).parent}/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(1)
    noise = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), n))
    italian = "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita. " * 20
    polish = "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. " * 20
    foreign = [noise(2000) for _ in range(10)] + [noise(20_000) for _ in range(10)] + [italian, polish]
    added = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in language.accepted(docs.unionByName(added)).select("doc_id").collect()}
    labelled = {r.doc_id for r in docs.where("lang IS NOT NULL AND length(text) > 0").collect()}
    assert not [d for d in kept if d < 0] and len(labelled & kept) >= 0.99 * len(labelled)


def test_the_language_stage_stores_no_texts(spark):
    """What it leaves in the shared folder is far less than its input; equal texts share their verdict."""
    path = f"{Path(SF).parent}/sf0.01/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text", "lang")
    noise = "".join(np.random.default_rng(5).choice(list("abcdefghijklmnopqrstuvwxyz     "), 2000))
    added = spark.createDataFrame([(-1, noise, None), (-1, noise, None), (-2, None, None), (None, noise, None)], docs.schema)
    before = len(session._made)
    kept = language.accepted(docs.unionByName(added))
    assert not kept.where("doc_id < 0 OR doc_id IS NULL").count()
    size = lambda top: sum(f.stat().st_size for f in Path(top).rglob("*.parquet"))
    stored = sum(size(folder.removeprefix("file://")) for folder in session._made[before:])
    given = size(path) or Path(path).stat().st_size
    assert 0 < stored < given / 4


def test_the_least_scores_come_from_all_rows(spark):
    """Of 60,000 rows every one counts: the few low ones, spread over all, move the least score as sorting says."""
    rng = np.random.default_rng(3)
    scores = np.where(np.arange(60_000) % 190 == 0, rng.uniform(0.1, 0.3, 60_000), rng.uniform(0.6, 0.9, 60_000))
    frame = spark.createDataFrame([(8, float(s)) for s in scores] + [(9, 0.5)] * 10 + [(7, 0.0)] * 100, "size int, score double")
    least = language.fit_least(frame)
    assert abs(least[8] - language.FIT_PART * np.percentile(scores, 100 * language.FIT_SHARE)) < 1e-4
    assert least[7] == language.LEAST_SCORE and least[9] == least[8] == least[63]


def brute_pipeline(docs):
    """doc_ids after language ID, exact and near dedup, one stage after the other."""
    texts = [(d.doc_id, d.text) for d in docs if any(c.isalpha() for c in d.text or "")]
    first = {}
    for d, t in sorted(texts):
        first.setdefault(" ".join(["", *t.split(), ""]), (d, t))
    classes = brute_classes(sorted(first.values()))
    return {d for d, c in classes.items() if d == c}


def test_pipeline_stages(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, at = docs.collect(), docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns, name
    assert sorted(r.doc_id for r in at.collect()) == sorted(brute_pipeline(rows))
    planned = {r.doc_id: r.copies for r in mixing.mix(at).collect()}
    at = corpus_pipeline.STAGES[3][1](spark, at, SF)
    mixed = at.collect()
    assert at.columns == docs.columns
    assert Counter(r.doc_id for r in mixed) == Counter({d: n for d, n in planned.items() if n})
    packed = corpus_pipeline.run(spark, SF).collect()
    sequences, least = checked_packing(packed, [(r.doc_id, r.text) for r in mixed], tokenizer)
    assert sequences <= least + 1


def test_pipeline_odd(spark, odd, nothing, tokenizer):
    at, empty = odd, nothing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at, empty = stage(spark, at, SF).persist(), stage(spark, empty, SF)
        assert at.columns == odd.columns and empty.count() == 0, name
    texts = [(r.doc_id, r.text) for r in at.collect()]
    assert not {1, 2, 3, 5, 7, 9, None} & {d for d, _ in texts}
    checked_packing(corpus_pipeline.packed_sequences(spark, at, SF).collect(), texts, tokenizer)
    assert corpus_pipeline.packed_sequences(spark, empty, SF).count() == 0


def test_pipeline_keeps_documents_without_an_id(spark, tokenizer):
    """They go as copies or near copies of others only; ids that different texts share name each by its text."""
    words = lambda n, m: " ".join(f"the house{n}x{k}" for k in range(m))
    long = words(1, 60)
    rows = [
        (1, long), (None, long), (None, long + " ending"), (None, words(2, 50)), (None, words(2, 50)), (None, words(3, 40)),
        (None, words(3, 40) + " more"), (None, words(4, 30)), (7, words(5, 30)), (7, long + " other"), (7, words(6, 30)), (None, "1234"),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, SF).persist()
        assert at.columns == docs.columns
    got = Counter((r.doc_id, r.text.removesuffix(" more")) for r in at.collect())
    assert got == Counter({(1, long): 1, (7, words(5, 30)): 1, (7, words(6, 30)): 1, **{(None, words(k, n)): 1 for k, n in ((2, 50), (3, 40), (4, 30))}})
    mixed = corpus_pipeline.mixed_sources(spark, at, SF).persist()
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert {k for k in times} <= {(r.doc_id, r.text) for r in at.collect()} and any(d is None for d, _ in times)
    packed = Counter((r.doc_id, r.length) for r in corpus_pipeline.packed_sequences(spark, mixed, SF).collect())
    assert packed == Counter((d, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for (d, t), n in times.items() for _ in range(n))
