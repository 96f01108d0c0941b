"""Each stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from test_chosen_path import brute as near_groups
from test_mixing import check as check_mix
from test_suffix_dedup import brute as repeats

import corpus_pipeline as P
from quotaflow.llm.chosen_path import shingles
from quotaflow.llm.common import table, written
from quotaflow.llm.mixing import mix_sources
from helpers import DOCS, SMALL, documents


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in P.STAGES:
        done = written(stage(spark, docs, SMALL), "stage")
        out.append((name, docs, done))
        docs = done
    return out


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_language_stage_keeps_every_text_with_a_clear_language(stages):
    _, before, after = stages[0]
    assert after.columns == list(P.COLUMNS) and set(rows(after, *P.COLUMNS)) <= set(rows(before, *P.COLUMNS))
    gone = set(rows(before, "doc_id", "text")) - set(rows(after, "doc_id", "text"))
    assert len(gone) <= 0.03 * before.count() and all(len(t or "") < 200 for _, t in gone)


def test_near_dedup_stage_keeps_the_first_of_each_group(stages, monkeypatch):
    import test_chosen_path

    plain = test_chosen_path.plain_set
    monkeypatch.setattr(test_chosen_path, "plain_set", lambda t, size=5: plain(t, 5))
    _, before, after = stages[1]
    want = {d for d, _, _, kept in near_groups(rows(before, "doc_id", "text"), 80) if kept}
    assert sorted(r[0] for r in rows(after, "doc_id")) == sorted(want) and len(shingles("a b c d e", 5)) == 1


def test_passage_stage_cuts_what_an_earlier_document_holds(stages):
    _, before, after = stages[2]
    left = {d: kept for d, _, _, _, kept in repeats(rows(before, "doc_id", "text"))}
    for d, text, n in rows(after, "doc_id", "text", "n_chars"):
        assert n == len(text)
        # whole characters: at most the bytes of a character more at either end of a run
        assert left[d].decode(errors="ignore") == text or len(text.encode()) - len(left[d]) <= 8 * 20


def test_mix_stage_takes_what_the_mix_takes(stages):
    _, before, after = stages[3]
    plan = mix_sources(before).collect()
    check_mix(plan, rows(before, "doc_id", "text", "source"))
    assert Counter(r[0] for r in rows(after, "doc_id")) == Counter({r["doc_id"]: len(r["shards"]) for r in plan if r["shards"]})


def test_token_stage_equals_the_library(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    _, before, after = stages[4]
    assert after.count() == before.count()
    for text, ids, decoded in rows(after, "text", "ids", "decoded"):
        assert ids == library.encode(text or "", add_eos=True) and decoded == library.decode(ids)


def test_nulls_and_empty_through_every_stage(spark):
    odd = documents(spark, [(None, None, None), ("", "en", "a"), ("the same words here", "en", None), ("the same words here", "de", "b"), ("x", None, "c")])
    odd = odd.union(spark.createDataFrame([(None, "no id but words", "en", "a", 1)], DOCS)).selectExpr("*", "1 AS id", "2 AS shard")
    for docs in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            docs = written(stage(spark, docs, SMALL), "odd")
        assert "ids" in docs.columns
