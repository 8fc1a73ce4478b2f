"""Chat rendering against SQL and by hand; the pipeline end to end."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarrylake.llm import chat_format, mixing, sentencepiece_codec, toxicity
from quarrylake.llm.queries import ORACLES, QUERIES

from .fixtures import corpus, frame
from .test_operators import brute_components

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, part string, mask int, perspective string"


def turn(*values):
    return (*values, "x", 1, "y")


def test_perspectives(spark):
    rows = [turn(1, 0, "system", "be kind"), turn(1, 1, "ann", "hi"), turn(1, 2, "bob", "<|im_end|>"), turn(1, 2, "bob", "<|im_end|>"), turn(1, None, None, None), turn(2, 0, "system", "alone"), turn(None, 0, "ann", "x")]
    got = {(r.conv_id, r.perspective): r for r in chat_format.perspectives(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, None), (None, "ann")}
    ann = got[1, "ann"]
    assert ann.rendered == "<|im_start|>user name=unknown\n<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n< |im_end|><|im_end|>\n" + "<|im_start|>user name=bob\n< |im_end|><|im_end|>\n"
    assert [ann.rendered[m.start : m.end] for m in ann.mask] == ["hi<|im_end|>"] and ann.n_masked == 12
    assert got[2, None].mask == [] and got[1, "bob"].n_turns == 5


def test_long_conversation_is_cut(spark):
    rows = [turn(1, i, "ab"[i % 2], f"t{i}") for i in range(1000)]
    got = chat_format.perspectives(spark.createDataFrame(rows, TURNS), 64).collect()
    assert len(got) == 2 * 16 and sum(r.n_turns for r in got) == 2000
    assert all(r.rendered[m.start : m.end].endswith("<|im_end|>") and r.rendered[: m.start].endswith("assistant\n") for r in got for m in r.mask)
    assert chat_format.perspectives(spark.createDataFrame([], TURNS)).collect() == []


def test_crowded_turn(spark, tmp_path):
    """One turn, and one utterance, with a third of all rows."""
    rows = [turn(1, None, "ann", f"said {i}") for i in range(700)] + [turn(1, None, "bob", "again")] * 600 + [turn(2, 3, "ann", "hi")] * 2
    made = spark.createDataFrame(rows, TURNS)
    got = chat_format.perspectives(made).collect()
    assert sum(r.n_turns for r in got) == 2 * 1300 + 2 and max(r.n_turns for r in got) < 512 and len({r.piece for r in got if r.conv_id == 1}) == 6
    made.select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    df = QUERIES["op9_chat_format"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op9_chat_format']})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet(['{SF}/{t}.parquet'])")
    df = QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_registered():
    assert [f"op{n}_" for n in range(1, 14)] == [n.split("_")[0] + "_" for n in QUERIES]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, left = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = left.count()
        left = stage(spark, left, SF)
        left = spark.createDataFrame(left.toPandas(), docs.schema)
        assert left.columns == names and (left.count() <= before or k == 3)
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in left.collect())
    assert all(r.round_trip for r in out)


def naive_score(lexicon, text):
    """Toxicity by looking for each entry at each place of the folded text."""
    t = toxicity.folded(text)
    best, spared = {}, []
    places = lambda e: [i for i in range(len(t)) if t.startswith(e, i)]
    for e, w in lexicon.entries.items():
        for i in places(e):
            best[i] = max(w, best.get(i, 0.0))
    for e in lexicon.exceptions:
        spared += [(i, i + len(e) - 1) for i in places(e)]
    for a, b in spared:
        best = {i: w for i, w in best.items() if not a <= i < b}
    bias, *curve = lexicon.curve
    z = bias + sum(x * y for x, y in zip(curve, toxicity._inputs(sum(best.values()), max(best.values(), default=0.0), t.count(" ") - 1), strict=True))
    return 1 / (1 + 2.718281828459045 ** -max(-30.0, min(30.0, z)))


def test_pipeline_against_brute_force(spark, tmp_path):
    """Nulls, blanks, repeated rows, copies, near copies, columns with the operators' own names, a third of all rows equal."""
    import sentencepiece

    rows = corpus() + [(9000 + i, f"what a vile grunk you are {i} " + "so go away now please " * 3, "en", "a", 9, *[None] * 8) for i in range(60)]
    rows += [(8000 + i, "the same text again and again in many rows", "en", "big", 9, *[None] * 8) for i in range(100)]
    frame(spark, rows).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(r[0], 1, int("grunk" in (r[1] or ""))) for r in rows]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    lexicon = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    left = [r for r in rows if naive_score(lexicon, r[1]) < 0.5]
    assert {r[0] for r in rows} - {r[0] for r in left} == {9000 + i for i in range(60)}
    groups = defaultdict(list)
    for r in left:
        groups[re.sub("[\x20\x09-\x0d]+", "", r[1] or "")].append(r)
    left = [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]
    keep = {d for d, _, c in brute_components(left) if d == c}
    left = [r for r in left if r[0] in keep]
    taken = {r.doc_id: r.taken for r in mixing.mix(frame(spark, left)).collect()}  # tested against brute force itself
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    words, texts = Counter(), {r[0]: r[1] or "" for r in left}
    for r in out:
        text = sp.decode(r.ids)
        assert sp.encode(text) == r.ids and r.round_trip and r.n_tokens == len(r.ids)
        assert texts[r.doc_id].split()[: len(text.split())] == text.split()
        words[r.doc_id] += len(text.split())
    assert +words == +Counter(taken) and set(words) <= keep


def test_pipeline_of_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
