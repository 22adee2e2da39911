"""The tensors that are stored beside the images are those that reading the images gives."""

from factweave.llm import media


def test_stored_tensors(spark):
    texts = [None, "", "some text " * 40, "é" * 5000, "z" * (media.MOST_MCUS * 384 + 70)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, tensors string").repartition(2)
    stored = media.media_columns(docs)
    own = {r.doc_id: r for r in stored.collect()}
    again = {(r.doc_id, r.image): r for r in media.tensors(stored).collect()}
    assert sum(len(r.tensors) for r in own.values()) == len(again)
    for r in own.values():
        assert len(r.tensors) == len(r.media)
        for i, t in enumerate(r.tensors):
            b = again[r.doc_id, i]
            assert (t.height, t.width, bytes(t.rgb)) == (b.height, b.width, bytes(b.rgb)) and len(t.rgb) == 3 * t.height * t.width
    digests = {r.doc_id: r.feature for r in media.media_columns(docs, digests=True).collect()}
    assert digests == {i: r.feature for i, r in own.items()}
    assert own[0].feature == own[1].feature
