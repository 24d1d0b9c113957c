"""The pipeline against the same stages in plain Python."""

from __future__ import annotations

import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from test_line_dedup import plain as plain_line_dedup  # noqa: E402
from test_mixing import SIZE, plain_targets  # noqa: E402
from test_near_dup import plain_classes  # noqa: E402

import corpus_pipeline  # noqa: E402
from marquee.llm import bpe, common, langid  # noqa: E402
from marquee.llm.common import prepare  # noqa: E402
from marquee.llm.queries import RANKS, SEED, learnable  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def mixed(rows):
    """[(doc_id, text, lang, source)] as often as the mix takes them whole."""
    by_source = defaultdict(list)
    for row in rows:
        draw = hashlib.md5(f"{SEED}:{'' if row[0] is None else row[0]}:{row[1] or ''}".encode()).hexdigest()
        by_source[row[3]].append((int(draw[:15], 16), row))
    size = lambda row: len(SIZE.findall(row[1] or ""))
    totals = {s: sum(size(r) for _, r in part) for s, part in by_source.items()}
    out = []
    for source, target in plain_targets(totals).items():
        demand, before = round(target), 0
        for _, row in sorted(by_source[source]):
            n = size(row)
            rounds = demand // max(1, totals[source])
            taken = rounds * n + max(0, min(n, demand - rounds * totals[source] - before))
            out += [row] * int(taken / max(1, n) + 0.5)
            before += n
    return out


def test_documents(spark):
    docs = prepare(spark).read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs.where(learnable()))
    labeller = langid.Labeller(model)
    rows = []
    for row in docs.collect():
        lang, score, _ = labeller.label(row.text or "")
        if lang != "und" and score >= 1 / 3:
            rows.append((row.doc_id, row.text, lang, row.source))
    deduped = plain_line_dedup([(r[0], r[1]) for r in rows])
    rows = [(k, deduped[k, t][0], lang, s) for k, t, lang, s in rows]
    rows = [r for r in rows if SIZE.search(r[1])]
    least = {(key, least) for key, least, _ in plain_classes([(r[0], r[1]) for r in rows])}
    rows = mixed([r for r in rows if (r[0], r[0]) in least])

    ranks = bpe.parse_ranks(bpe.read_ranks(RANKS))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((k, lang, s, tuple(library.encode_ordinary(t))) for k, t, lang, s in rows)
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in found) == expected
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)


CLASHING = ["position", "size", "n_removed", "n_lines", "lang_pred", "lang_score", "target", "class", "ids", "other_column_1"]


def test_stages_keep_the_columns(spark, odd_documents, no_documents):
    """Extra columns keep their values, whatever they are called."""
    mark = F.concat_ws("/", F.col("doc_id").cast("string"), F.substring("text", 1, 9))
    for table in (odd_documents, no_documents):
        docs = table
        for name in CLASHING:
            docs = docs.withColumn(name, F.concat(F.lit(f"{name}:"), mark))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SMALL)
            assert after.columns == docs.columns, name
            before = {tuple(r) for r in docs.select("doc_id", *CLASHING).collect()}
            assert {tuple(r) for r in after.select("doc_id", *CLASHING).collect()} <= before, name
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_run_deletes_its_steps(spark, odd_documents, no_documents, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "STORED", [])
    monkeypatch.setattr(corpus_pipeline, "STORED", common.STORED)
    for name, table in (("odd", odd_documents), ("none", no_documents)):
        since = len(common.STORED)
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / name))
        assert all(r.round_trip for r in found.collect())
        assert len(common.STORED) == since + 1  # what the last stage reads
    assert found.collect() == []


def test_copies_end_with_one(spark):
    rows = [(i, f"word{i % 3} " * 30 + "and the same text again", "en", "a", 9) for i in range(30)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.dedup_near(spark, docs, SMALL).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2]


def test_repeated_rows_end_with_one(spark, odd_documents):
    kept = corpus_pipeline.dedup_near(spark, odd_documents, SMALL).collect()
    # Alike are 7, 9 and both rows of 8, and so are 12 and 13.
    assert len(kept) == len({(r.doc_id, r.text) for r in kept}) == odd_documents.count() - 4
    rows = [(None, "a text that comes without an id " * 9, "en", s, 9) for s in "cabab"]
    rows += [(None, None, "en", "a", None)] * 3 + [(4, "", "en", "b", 0), (4, "", "en", "a", 0)]
    rows += [(8, "own words that come twice under one id", "en", s, 9) for s in "ba"]
    docs = prepare(spark).createDataFrame(rows, odd_documents.schema)
    kept = corpus_pipeline.dedup_near(spark, docs, SMALL).collect()
    found = Counter((r.doc_id, (r.text or "")[:5], r.source) for r in kept)
    assert found == Counter([(None, "a tex", "a"), (None, "", "a"), (4, "", "a"), (8, "own w", "a")])
