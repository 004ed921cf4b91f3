"""The pipeline's stages, each against brute force on what the one before kept."""

import os
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_dir

from test_operators import brute_contaminated, brute_line_dedup, brute_near_duplicates, text


def test_pipeline_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, folder)
        assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns, name
    before = {p for p in os.listdir(shared_dir(spark).removeprefix("file:")) if p.startswith("cut-")}
    out = corpus_pipeline.run(spark, folder)
    # of all that the stages wrote only the last one's documents are left, which the result reads
    assert len({p for p in os.listdir(shared_dir(spark).removeprefix("file:")) if p.startswith("cut-")} - before) == 1
    assert out.columns == ["doc_id", "n_pieces", "piece_ids", "lossless"]
    assert out.where("NOT lossless").count() == 0 and 0 < out.count() <= docs.count()


def passes_rules(t):
    """The current policy by its definition."""
    t = t or ""
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t) if x]
    n = len(w)
    chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t)
    lines = [x for x in t.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    often = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeated = len({i + k for i in range(n - 2) if often[tuple(w[i : i + 3])] > 1 for k in range(3)})
    upper = sum(c.isupper() for c in t)
    return not (
        n < 50 or 100 * repeated > 50 * n or 100 * symbols > 30 * n or 100 * t.count("!") > 30 * n or 100 * upper > 50 * chars
        or 100 * (len(lines) - len(set(lines))) > 40 * len(lines) or chars > 15 * n or chars < 2 * n
    )


def made_rows(items):
    note = "This notice stands at the end of very many documents of the table"
    rows = [(k, text(13 * k, 90) + (f"\n{note}\nown line {k}" if k % 2 else "")) for k in range(24)]
    rows += [(100 + k, text(0, 90) + f" tail {k}") for k in range(3)] + [(110, text(0, 90)), (110, text(0, 90)), (None, text(5, 90)), (None, None), (111, None), (112, "")]
    rows += [(200 + k, f"{text(300 + 31 * k, 60)} {t} {text(310 + 17 * k, 60)}") for k, (_, t) in enumerate(items)]
    rows += [(300, "A! " * 80), (301, text(4, 49)), (302, "x y z " * 60), (303, text(6, 80).upper()), (304, "# | " * 60), (305, "same line here\n" * 40), (306, "q" * 3000 + text(2, 60))]
    return rows


def test_every_stage_against_brute_force(spark, tmp_path):
    items = [(1, text(7, 30).replace("w", "z")), (2, "A train leaves at 9 and travels 40 km in the hour while Bob waits for 40 minutes near the old stone bridge"), (3, None)]
    rows = made_rows(items[:2])
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "h": F.lit(1), "key": F.lit("k"), "t": F.lit(2), "lost": F.lit(3), "line_n_lines": F.lit(4), "class_id": F.lit(5)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pairs = lambda d: Counter((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    columns = docs.columns
    stages = [stage for _, stage in corpus_pipeline.STAGES]

    docs = stages[0](spark, docs, str(tmp_path))
    kept = [r for r in rows if passes_rules(r[1])]
    assert docs.columns == columns and pairs(docs) == Counter(kept) and len(kept) < len(rows)

    docs = stages[1](spark, docs, str(tmp_path))
    left = [(k, t) for k, _, _, t in brute_line_dedup(kept)]
    assert docs.columns == columns and pairs(docs) == Counter(left) and left != kept
    assert docs.where("n_chars != length(text)").count() == 0

    docs = stages[2](spark, docs, str(tmp_path))
    classes = brute_near_duplicates(left)
    first = {k: min((left[x][0] for x in seen if left[x][0] is not None), default=None) for k, (seen, _) in classes.items()}
    one = Counter({(k, t): 1 for n, (k, t) in enumerate(left) if k is not None and first[n] == k})
    one += Counter(r for r in left if r[0] is None)
    assert docs.columns == columns and pairs(docs) == one and sum(one.values()) < len(left)

    docs = stages[3](spark, docs, str(tmp_path))
    bad = {doc for doc, _ in brute_contaminated(list(one), items)}
    clean = Counter({r: n for r, n in one.items() if r[0] is None or r[0] not in bad})
    assert docs.columns == columns and pairs(docs) == clean and {200, 201} <= bad

    out = stages[4](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter(k for k, _ in clean.elements()) and all(r.lossless for r in out)
    assert Counter((r.doc_id, r.n_pieces) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter((r.doc_id, r.n_pieces) for r in out)


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, table in (("documents", docs), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
