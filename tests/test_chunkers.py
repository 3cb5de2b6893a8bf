import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagebrook.functions.chunkers import Character, FormatAware, Paragraph, Recursive, Ruler, Semantic, Sentence
from sagebrook.operators.chunking import chunk, valid_chunk

ALL = [Character(40, 5), Sentence(60), Sentence(60, 20), Paragraph(60), Paragraph(60, 30), Recursive(50), FormatAware("markdown", 60, 10)]
TEXT = st.text(st.sampled_from("ab. \n!?é世👩‍🚀🇺🇸\r\t#-"), max_size=300)


def contents(chunker, text):
    return [c["content"] for c in chunker.chunk(text)]


def check(chunker, text):
    raw, limit = text.encode(), getattr(chunker, "max_chars", None) or chunker.chunk_size
    for n, c in enumerate(chunker.chunk(text)):
        assert raw[c["start_byte"] : c["end_byte"]].decode() == c["content"]
        assert c["index"] == n
        assert Ruler(c["content"]).size((0, len(c["content"]))) <= limit


@given(TEXT)
@settings(max_examples=60, deadline=None)
def test_invariants(text):
    for chunker in ALL:
        check(chunker, text)


def test_goldens():
    """Results worked out by hand."""
    walk = "The gate was shut. A lamp hung over it. Nobody came by."
    # 40 characters reach into "Nobody"; the last sentence end within them is behind "it." at 39, past half of the limit.
    assert contents(Character(40, 5), walk) == ["The gate was shut. A lamp hung over it.", "r it. Nobody came by."]
    # No sentence ends past half of the limit: the cut is before the last blank.
    assert contents(Character(30, 0), "Wide rivers carry heavy barges slowly south") == ["Wide rivers carry heavy", " barges slowly south"]
    # Sentences are joined until they have 20 characters.
    assert contents(Sentence(60, 20), "Go on. Stop. Wait a bit. Turn left. Run.") == ["Go on. Stop. Wait a bit.", "Turn left. Run."]
    assert contents(Sentence(60), "Is it 3.5 km? Yes!  And then") == ["Is it 3.5 km?", "Yes!", "And then"]
    assert contents(Paragraph(), "Salt.\r\n\r\nPepper and oil.\n\n\n\n  Bread. \n \nWine.") == ["Salt.", "Pepper and oil.", "Bread.", "Wine."]
    # Short paragraphs take in the next ones; oversized ones are cut at sentences.
    assert contents(Paragraph(60, 11), "Salt.\n\nOil.\n\nA loaf of dark bread.") == ["Salt.\n\nOil.", "A loaf of dark bread."]
    assert contents(Paragraph(25), "The oven is hot. The dough is cold.\n\nEnd.") == ["The oven is hot.", "The dough is cold.", "End."]
    cut = Recursive(30).chunk("A short start.\n\nThe oven is hot. The dough is still cold.\n\n" + "q" * 64)
    assert [(c["metadata"]["hierarchy"], len(c["content"])) for c in cut] == [("paragraph", 14), ("sentence", 16), ("sentence", 24), ("character", 30), ("character", 30), ("character", 4)]


def test_empty_texts():
    assert [len(c.chunk("")) for c in (Character(), Recursive(), FormatAware(), Sentence(), Paragraph(), Semantic(lambda t: t))] == [1, 1, 1, 0, 0, 0]
    assert Character().chunk(None) == []


def test_semantic_groups():
    vectors = {"Rain fell.": [1, 0, 0], "It poured.": [1, 0, 0], "Taxes rose.": [0, 1, 0]}
    groups = contents(Semantic(lambda texts: [vectors[t] for t in texts]), "Rain fell. It poured. Taxes rose.")
    assert groups == ["Rain fell. It poured.", "Taxes rose."]
    with pytest.raises(ValueError):
        Semantic().chunk("A. B.")


def test_overlap_never_hangs():
    assert len(contents(Character(10, 50), "word " * 50)) < 300
    assert contents(Character(1, 0), "abc") == ["a", "b", "c"]


def test_format_aware():
    parts = contents(FormatAware("markdown", 40, 0), "# One\n\nText of one.\n\n# Two\n\nText of two that is a bit longer.")
    assert any(p.lstrip().startswith("# Two") for p in parts)
    with pytest.raises(ValueError):
        FormatAware("nothing").chunk("x")


def test_column(spark):
    df = spark.createDataFrame([(1, "One. Two.", "x"), (2, None, "y"), (3, "", "z"), (1, "One. Two.", "x")], "id long, text string, extra string")
    ok = valid_chunk(F.lit("One. Two."), F.col("content"), F.col("start_byte"), F.col("end_byte"))
    out = chunk(df, Sentence(), "text").withColumn("ok", ok).collect()
    assert sorted((r.id, r["index"], r.content, r.extra) for r in out) == [(1, 0, "One.", "x"), (1, 0, "One.", "x"), (1, 1, "Two.", "x"), (1, 1, "Two.", "x")]
    assert all(r.ok for r in out)
    with pytest.raises(ValueError):
        chunk(df.withColumnRenamed("extra", "content"), Sentence(), "text")
    assert chunk(df.where("false"), Sentence(), "text").count() == 0
