"""Views, search, rendering, changes and ingest on small snapshots written by hand."""

import json
import os

import pytest
from conftest import SF
from pyspark.sql import functions as F

from shellac.operators import browse, dml, ingest, numbering, render, search, sync
from shellac.plans import commands, queries
from shellac.schema import TABLES, Dimension
from shellac.sources.adapters import adapted
from shellac.sources.catalogue import Catalogue, drop_catalogue, empty_catalogue, read_catalogue
from shellac.sources.files import present_ids
from shellac.sources.json_files import parse_download, read_ingest


def catalogue(spark, **rows):
    base = {"artists": [(1, "No artist provided"), (2, "Ann")], "origins": [(1, "No origin provided"), (2, "Game")], "tags": [(1, "x"), (2, "calm")], "tracks": [], "track_tags": []}
    return Catalogue(**{name: spark.createDataFrame({**base, **rows}[name], schema) for name, schema in TABLES.items()})


@pytest.fixture
def small(spark):
    tracks = [("a", "d", "y", "Boss", 2, 2), ("b", "d", "y", "Alone", 1, 2), ("o", "d", "y", "Orphan", 99, 2), ("c", "d", "y", "Boss", 2, 1)]
    return catalogue(spark, tracks=tracks, track_tags=[("a", 1), ("a", 2), ("b", 2)])


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_orphans_keep_their_rows(small):
    assert ("Orphan", "No artist", "Game", "") in pairs(browse.browse_all(small), "track_title", "artist", "origin", "tags")
    assert browse.lookup(small, "o").first()["artist"] is None
    assert pairs(search.search_tracks(small, "orph"), "id", "artist") == [("o", None)]
    assert [r["id"] for r in browse.browse_artists(small).orderBy("pos").collect()] == ["o", "a", "c", "b"]


def test_lookup_and_require(small):
    assert browse.lookup(small, "zz").count() == 0
    with pytest.raises(LookupError):
        browse.require(small, "zz")


def test_a_track_found_by_tag_shows_matching_tags_only(small):
    by_tag = {r["id"]: r["tags"] for r in search.search_tracks(small, "calm").collect()}
    assert by_tag == {"a": "calm", "b": "calm"}
    assert {r["id"]: r["tags"] for r in search.search_tracks(small, "boss").collect()} == {"a": "calm, x", "c": None}
    assert {r["id"]: r["tags"] for r in search.search_incomplete(small, "a").collect()} == {"b": "calm", "c": None}


def test_limit_comes_before_the_sort(spark):
    c = catalogue(spark, tracks=[(f"{i:03}", "d", "y", f"t{99 - i}", 2, 2) for i in range(60)])
    shown = search.complete_tracks(c, "t").orderBy("pos").collect()
    assert sorted(r["id"] for r in shown) == [f"{i:03}" for i in range(25)]
    assert [r["display"] for r in shown] == sorted(r["display"] for r in shown)
    assert shown[0]["display"] == "t75 | Ann | Game | No tags"


def test_numbering_by_ranges_equals_one_window(spark):
    df = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("k"), "id")
    one, ranges = numbering.number_rows(df, ["k"], total="n"), numbering.number_rows(df, ["k"], total="n", small_input=-1)
    assert pairs(one, "id", "pos", "n") == pairs(ranges, "id", "pos", "n")
    assert numbering.number_rows(df.limit(0), ["k"], small_input=-1).count() == 0


def test_grouped_lines(spark):
    c = catalogue(spark, artists=[(1, ""), (2, "A"), (3, "B" * 50)], tracks=[("1", "d", "y", "p", 1, 2), ("2", "d", "y", "q", 2, 2), ("3", "d", "y", "r", 2, 2), ("4", "d", "y", "s", 3, 2)])
    lines = [r["line"] for r in render.grouped_lines(browse.browse_artists(c, "total"), "artist").orderBy("line_no").collect()]
    assert lines == ["  1. p", "── A", "  2. q", "  3. r", "", "── " + "B" * 39 + "…", "  4. s"]


def test_flat_pages(spark):
    c = catalogue(spark, tracks=[(f"{i:02}", "d", "y", f"title {i:02}", 2, 1) for i in range(16)])
    pages = [r["body"] for r in render.library_pages(c, "all").orderBy("page").collect()]
    assert len(pages) == 2 and pages[0].startswith("```\n 1. title 00\n      Ann\n\n 2. title 01") and pages[1] == "```\n16. title 15\n      Ann\n\n```"
    assert render.library_pages(catalogue(spark), "all").count() == 0


def test_dictionary_is_exact_and_case_sensitive(small, spark):
    names = spark.createDataFrame([("Ann",), ("ann",), (None,), ("ann",), ("Zoe",)], "n string")
    out = dml.encode_names(small.artists, "artist", names)
    assert [r[0] for r in out.orderBy("id").select("artist").collect()] == ["No artist provided", "Ann", "Zoe", "ann"]
    assert out.select("id").distinct().count() == 4


def test_insert_or_ignore_is_idempotent(small, spark):
    new = spark.createDataFrame([("a", "x"), ("c", "new"), ("c", "new")], "track_id string, tag string")
    once = dml.add_tags(small, new)
    twice = dml.add_tags(once, new)
    assert pairs(once.track_tags, "track_id", "tag_id") == pairs(twice.track_tags, "track_id", "tag_id")
    assert once.track_tags.count() == 4 and twice.tags.count() == 3


def test_insert_track_twice_raises(small, spark):
    row = spark.createDataFrame([("a", "d", "y", "t", 1, 1)], TABLES["tracks"])
    with pytest.raises(ValueError, match="'a'"):
        dml.insert_tracks(small, row)
    fresh = spark.createDataFrame([("n", None, None, None, 1, 1)], TABLES["tracks"])
    got = dml.insert_tracks(small, fresh).tracks.where("id = 'n'").first()
    assert (got["upload_date"], got["yt_title"], got["track_title"]) == ("Unknown Date", "Unknown Title", "Unknown Title")


def test_patch_changes_only_what_it_names(small, spark):
    patch = spark.createDataFrame([("a", None, "New", None), ("b", "T", None, None), ("zz", "q", None, None)], "id string, title string, artist string, origin string")
    out = dml.patch_tracks(small, patch)
    assert pairs(browse.browse_all(out), "id", "track_title", "artist", "origin") == [("a", "Boss", "New", "Game"), ("b", "T", "No artist provided", "Game"), ("c", "Boss", "Ann", "No origin provided"), ("o", "Orphan", "No artist", "Game")]


def test_reset_keeps_the_dictionary_and_cascade_drops_orphans(small):
    out = dml.reset_tags(small, "a")
    assert pairs(out.track_tags, "track_id", "tag_id") == [("b", 2)] and out.tags.count() == 2
    assert pairs(dml.cascade(small).tracks, "id") == [("a",), ("b",), ("c",)]


def test_ingest_first_write_wins_and_tags_add_up(small, spark, tmp_path):
    records = [
        {"id": "a", "upload_date": "1", "yt_title": "z", "track_title": "z", "tags": ["boss fight"]},
        {"id": "n", "upload_date": "2", "yt_title": "n", "track_title": "second", "track_artist": "Q"},
        {"id": "n", "upload_date": "1", "yt_title": "n", "track_title": "first", "tags": ["x", None]},
        {"track_title": None, "track_origin": "Somewhere"},
    ]
    for i, r in enumerate(records):
        (tmp_path / f"{i}.json").write_text(json.dumps(r, indent=1))
    out = ingest.ingest(small, read_ingest(spark, str(tmp_path)))
    rows = {r["id"]: r for r in browse.browse_all(out).collect()}
    assert rows["a"]["track_title"] == "Boss" and rows["a"]["tags"] == "boss fight, calm, x"
    assert (rows["n"]["track_title"], rows["n"]["artist"], rows["n"]["tags"]) == ("first", "No artist provided", "x")
    assert (rows["null"]["track_title"], rows["null"]["origin"]) == ("null", "Somewhere")
    split = ingest.ingest(small, read_ingest(spark, str(tmp_path)), split_ws=True)
    assert {"boss", "fight"} <= {r["tag"] for r in split.tags.collect()}


def test_download_records_need_their_keys(spark):
    texts = [json.dumps(x) for x in ({"id": "1", "upload_date": None, "title": "t", "channel": "c", "more": 1}, {"id": "1", "title": "t"}, {"id": "2", "upload_date": "d", "title": 5, "channel": "c"})] + ["no json"]
    good, bad = parse_download(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert pairs(good.select("id"), "id") == [("1",), ("2",)] and bad.count() == 2


def test_resolve_and_commands(small, spark):
    known, missing = ingest.resolve(small, spark.createDataFrame([("a",), ("https://youtu.be/b",), ("https://youtu.be/q",), ("q",)], "input string"))
    assert pairs(known, "id") == [("a",), ("b",)] and pairs(missing, "id", "valid") == [("q", False), ("q", True)]
    with pytest.raises(ValueError):
        commands.play(small, "q")
    with pytest.raises(LookupError):
        commands.play(small, "https://youtu.be/q")
    out, said = commands.fix(small, "a", title="T", origin="O")
    assert said == "title, origin" and commands.fix(small, "a")[1] == "no changes"
    assert browse.lookup(out, "a").first()["origin"] == "O"
    record = spark.createDataFrame([("d1", "2024", "A film")], "id string, upload_date string, title string")
    got = browse.lookup(commands.download(small, record, artist="Zed"), "d1").first()
    assert (got["title"], got["artist"], got["origin"]) == ("A film", "Zed", "No origin provided")
    assert "new" in browse.browse_all(commands.add_tag(small, "c", "new")).where("id = 'c'").first()["tags"]
    assert browse.lookup(commands.COMMANDS["set_artist"](small, "a", "Neu"), "a").first()["artist"] == "Neu"


def test_reconcile_counts_add_up(small, spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"x")
    (tmp_path / "note.txt").write_bytes(b"x")
    calls = []
    assert sync.fetch_with_retry(lambda i: calls.append(i) or 1 / 0, "q", pause=lambda s: None) == "skipped" and len(calls) == 3
    assert sync.fetch_with_retry(lambda i: False, "q") == "skipped"
    outcomes = sync.reconcile(small.tracks, present_ids(spark, str(tmp_path)), lambda i: i == "b", pause=lambda s: None)
    got = sync.sync_stats(outcomes).first()
    assert got.asDict() == {"total": 4, "present": 1, "downloaded": 1, "failed": 0, "skipped": 2}


def test_what_is_there_includes_folders_empty_and_hidden_files(small, spark, tmp_path):
    for name in ("a.mp3", "_b.mp3", ".c.mp3", "100%+d.mp3", "e, f.mp3", "no.mp3.part", ".mp3", "g.MP3"):
        (tmp_path / name).touch()
    for name in ("o.mp3", "sub.mp3", "k=1"):
        (tmp_path / name).mkdir()
    for name in ("sub.mp3/x", "k=1/z.mp3"):
        (tmp_path / name).write_bytes(b"x")
    assert pairs(present_ids(spark, str(tmp_path)), "id") == [(".c",), ("100%+d",), ("_b",), ("a",), ("e, f",), ("o",), ("sub",)]
    assert pairs(sync.missing_files(small.tracks, present_ids(spark, f"file://{tmp_path}/")), "id") == [("b",), ("c",)]
    assert present_ids(spark, str(tmp_path), ".ogg").count() == 0


def test_tables_that_are_folders_are_present_files(spark, duck, tmp_path):
    for file in os.listdir(SF):
        (tmp_path / file).symlink_to(f"{SF}/{file}")
    for table in ("documents", "pages"):
        (tmp_path / f"{table}.parquet").unlink()
        (tmp_path / f"{table}.parquet").mkdir()
        for part in range(2):
            (tmp_path / f"{table}.parquet/part-{part}.parquet").symlink_to(f"{SF}/{table}.parquet")
    assert pairs(queries.QUERIES["present_files"](spark, str(tmp_path)), "id") == sorted(duck.sql(queries.ORACLES["present_files"]).fetchall())


def test_write_read_register_drop(small, spark, tmp_path):
    small.write(str(tmp_path / "c"))
    again = read_catalogue(spark, str(tmp_path / "c"))
    assert pairs(again.tracks, "id") == pairs(small.tracks, "id")
    again.register()
    assert spark.sql("SELECT count(*) FROM track_tags").first()[0] == 3
    drop_catalogue(spark)
    assert empty_catalogue(spark).artists.first()["artist"] == "No artist provided"
    assert search.search_dimension(small, Dimension.TAG, "A").first()["name"] == "calm"


def test_titles_of_documents_are_the_whole_texts(spark):
    """Matches late in a text, and after its first line, are found."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    c = adapted(spark, SF)
    assert pairs(c.tracks, "id", "track_title") == pairs(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("track_title")), "id", "track_title")
    late = next(r["text"] for r in docs.orderBy("doc_id").collect() if len(r["text"]) > 1000)[-40:].replace("%", "").replace("_", "")
    assert search.search_tracks(c, late).count() > 0


def test_parts_have_the_tags_of_all_their_line_items(spark):
    suppliers = {r["s_suppkey"]: r["s_nationkey"] for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    want = {(str(r["l_partkey"]), suppliers[r["l_suppkey"]]) for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect()}
    assert pairs(adapted(spark, SF, "parts").track_tags, "track_id", "tag_id") == sorted(want)
