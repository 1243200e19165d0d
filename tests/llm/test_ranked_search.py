import math
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.test_leaks import brute_words
from volscribe.llm import queries, ranked_search as rs


def brute_ranks(docs, items, best=20):
    """Every item's best documents as (rank, doc_id, score), scored one by one."""
    texts = [(doc_id, Counter(brute_words(text.replace("@", " ").replace("`", " ") if text else text))) for doc_id, text in docs]
    texts = [(d, c) for d, c in texts if c]
    number, length = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    out = []
    for item_id, text in items:
        own, scored = Counter(brute_words(text)), []
        for doc_id, c in texts:
            n, score = sum(c.values()), 0
            m = 75 + (25 * n * number) // length
            for w, times in own.items():
                if w in c:
                    weight = math.floor(1000 * math.log((2 * number + 2) / (2 * df[w] + 1)))
                    score += times * weight * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op11_equals_brute_force(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").selectExpr(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows(queries.QUERIES["op11_ranked_search"](spark, SF)) == brute_ranks(docs, items)


@pytest.fixture(scope="module")
def made_up():
    """Skewed words, a third of all rows one text, equal scores, and texts of very different lengths."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    chance = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)) * int(rng.choice([1, 1, 20])), p=chance / chance.sum())) for _ in range(700)]
    texts += [texts[5]] * 350
    docs = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    items = [(k, " ".join(rng.choice(words, 12))) for k in range(25)] + [(25, "w0"), (26, "w0 w1 w0"), (27, "absent"), (28, texts[5]), (28, "w7")]
    return docs, items


@pytest.mark.parametrize("query_terms", [50, 10_000])
def test_shards_and_blocks_of_any_size_rank_the_same(spark, made_up, monkeypatch, query_terms):
    docs, items = made_up
    monkeypatch.setattr(rs, "SHARD_DOCS", 100)
    monkeypatch.setattr(rs, "BLOCK_DOCS", 4)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    if query_terms == 50:
        frames = frames[0], frames[1].where("item_id >= 24")
        items = [i for i in items if i[0] >= 24]
    assert rows(rs.search(*frames, query_terms=query_terms)) == brute_ranks(docs, items)


def test_bounds_hold_and_skip_blocks(spark, made_up):
    """A block's bound is never below the score of one of its documents, and some blocks are skipped."""
    docs, items = made_up
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    block = rs.query_blocks(spark.createDataFrame(items, "item_id long, text string")).first()
    forward = rs.written(rs.forward_rows(frame, rs.pickle.loads(block.queries)[1]), "forward")
    own = rs.Queries(bytes(block.queries), *rs._statistics(forward, len(rs.pickle.loads(block.queries)[1])), 20)
    for r in rs._ranked(rs._seeded(forward, own), 20).where("rank = 20").collect():
        own.least[r["query"]] = r.score
    own.plan()
    opened = all_blocks = 0
    for r in rs.build_index(forward, own).collect():
        shard = rs._read(r.asDict())
        best = rs.Best(own)
        opened += rs.visit(shard, own, best)
        for k, (numbers, _) in enumerate(own.own):
            vector = own.vector(k)
            scores = np.array([(vector[shard.term[a:b]] * shard.impact[a:b].astype(np.int64)).sum() for a, b in zip(shard.at, shard.at[1:])])
            for b in np.flatnonzero(np.isin(shard.block_term, numbers[: own.needed(k, own.most)])).tolist():
                part = slice(shard.summary_at[b], shard.summary_at[b + 1])
                bound = (vector[shard.summary_term[part]] * shard.summary[part].astype(np.int64) * rs.STEP).sum()
                assert bound >= scores[shard.member[shard.member_at[b] : shard.member_at[b + 1]]].max()
                all_blocks += 1
    assert 0 < opened < all_blocks


def test_op11_odd(odd, nothing):
    items = odd.selectExpr("doc_id AS item_id", "text", "lang AS rank", "source AS score")
    got = rows(rs.search(odd, items))
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    assert got == brute_ranks(pairs, pairs) and {r[0] for r in got} >= {4, 9, None}
    assert rs.search(nothing, items).count() == rs.search(odd, items.where("false")).count() == 0
