"""Pipeline stages over tables whose extra columns are named like the helpers inside."""

import pytest

import corpus_pipeline

NAMES = [
    "h", "_h", "_id", "id", "t", "doc", "gone", "ls", "keep", "fresh", "drop_id", "drop_h", "n_lines", "n_dropped", "lines", "parts", "bands",
    "last", "last_e", "last_domain", "last_lang", "last_source", "order_key", "epoch", "domain", "n_tokens", "n_words", "chosen", "class_id",
    "key", "keys", "fail_bits", "k", "b", "e", "Bits", "a.b",
]


def _documents(spark, extra):
    rows = [(i, " ".join(f"word{(i * 37 + k) % 911}" for k in range(70)) + f"\nthe same footer of every page number {i}", "en", f"src{i % 3}", 0) for i in range(12)]
    rows += [(None, None, None, None, None), (50, "", "de", "src1", 0), (3, *rows[3][1:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", *[f"'x' as `{n}`" for n in extra]).repartition(3)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_extra_columns_change_nothing(spark, name, stage):
    plain, wide = (stage(spark, _documents(spark, extra), "") for extra in ([], NAMES))
    shown = ["doc_id", "text"] if "text" in plain.columns else ["doc_id", "start", "length", "ids_crc32"]
    rows = [sorted((tuple(r) for r in df.select(*shown).collect()), key=str) for df in (plain, wide)]
    assert rows[0] == rows[1] and rows[0]
    if name != "packing":
        assert wide.columns == _documents(spark, NAMES).columns
