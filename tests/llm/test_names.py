"""Columns that have the name of a result in another case are replaced, as Spark knows no case."""

from clonespark.llm import bpe, gif, quality
from clonespark.llm.line_dedup import dedup_lines
from clonespark.llm.secret_scan import redact


def held(df, *names):
    low = [c.lower() for c in df.columns]
    assert len(set(low)) == len(low) and all(low.count(n) == 1 for n in names), df.columns
    return df.select(*names).collect()


def test_names_in_another_case(spark, table):
    text = "one two\nthree"
    docs = table([(1, text), (2, text)], extra=False).selectExpr("doc_id", "text", "7 AS N_LINES", "7 AS N_Removed", "7 AS SPANS", "7 AS Score", "7 AS FRAMES", "7 AS Samples", "7 AS DECODED")
    assert [tuple(r) for r in held(dedup_lines(docs, 2).orderBy("doc_id"), "n_lines", "n_removed")] == [(2, 0), (2, 2)]
    assert [r.spans for r in held(redact(docs), "spans")] == [[], []]
    net = quality.train(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert all(0 <= r.score <= 1 for r in held(quality.score(docs, net), "score"))
    read = gif.decode_media(gif.encode_texts(docs))
    assert all(r.frames and r.samples for r in held(read, "frames", "samples"))


def test_decoded_in_another_case(spark, table):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table([(1, "some words")], extra=False), path, public_tokenizers.PATTERN).selectExpr("*", "7 AS DECODED")
    assert [bytes(r.decoded) for r in held(bpe.decode(ids, path), "decoded")] == [b"some words"]
