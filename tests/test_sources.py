import datetime as dt
import json
import os

import pytest

from gatherlens.operators.corpus import category_topics
from gatherlens.operators.occurrence import event_time_info
from gatherlens.sources import entities as E
from gatherlens.sources import lookups as L
from gatherlens.sources import sinks as SK

GROUPS = [
    {"id": 1, "name": "Chess <b>Club</b> of NYC", "city": "New York", "state": "NY",
     "timezone": "America/New_York", "lon": -74.0, "lat": 40.7, "rating": 0, "members": 0,
     "created": 1500000000999, "organizer": {"member_id": 77}, "category": {"id": 11},
     "topics": [{"urlkey": "chess"}, {"urlkey": "board-games"}], "description": "<p>We play\nchess</p>",
     "who": "players", "link": "http://x", "group_photo": {"photo_link": "http://p"}},
    {"id": 2, "name": "No category", "city": "Chicago", "timezone": "America/Chicago"},
    {"id": 3, "name": "Unmapped", "city": "Chicago", "timezone": "America/Chicago",
     "category": {"id": 7}, "rating": 4.5},
    {"id": 4, "name": "Tags only", "city": "Chicago", "timezone": "America/Chicago",
     "category": {"id": 34}, "description": "<br/><hr>", "rating": 0.0},
]
EVENTS = [
    {"id": "a1", "name": "Night game", "venue": {"id": 5}, "rating": {"count": 0, "average": 0.0},
     "event_hosts": [{"member_id": 1}, {"member_id": 2}], "yes_rsvp_count": 12,
     "group": {"id": 1}, "created": 1500000000000, "time": 1710052200000, "updated": None},
    {"id": "a2", "name": "Morning game", "venue": None, "group": {"id": 1},
     "time": 1710055800000},
    {"id": "a3", "group": {"id": 4}},   # no time at all
]
VENUES = [
    {"id": 5, "name": "Hall", "lat": 40.7, "lon": -74.0, "rating": 0, "rating_count": 3,
     "address_1": "1 Main St", "zip": "10001", "city": "New York", "state": "NY"},
    {"id": 6, "name": "Hall B", "lat": 40.7, "lon": -74.0},
]
RSVPS = [{"rsvp_id": 9, "response": "yes", "member": {"member_id": 3}, "event": {"id": "a1"},
          "venue": {"id": 5}, "group": {"id": 1}, "created": 1500000000999, "mtime": 1500000001000}]


def write_lines(folder, name, records, extra=()):
    d = os.path.join(folder, name)
    os.makedirs(d)
    with open(os.path.join(d, "part-0.json"), "w") as f:
        for r in records:
            f.write(json.dumps(r) + "\n")
        for line in extra:
            f.write(line + "\n")
    return d


@pytest.fixture()
def data_dir(tmpdir_path):
    write_lines(tmpdir_path, "groups", GROUPS, extra=["{not json"])
    write_lines(tmpdir_path, "events", EVENTS)
    write_lines(tmpdir_path, "venues", VENUES)
    write_lines(tmpdir_path, "rsvps", RSVPS)
    return tmpdir_path


def test_groups(spark, data_dir):
    cats = L.category_topics(spark)
    g = E.load_entity(spark, data_dir, "group", cats, on_error="drop")
    got = {r.group_id: r for r in g.collect()}
    assert set(got) == {1, 3, 4} and got[3].topic is None     # no category dropped
    with pytest.raises(Exception):
        E.load_entity(spark, data_dir, "group", cats).collect()      # a malformed line
    one = got[1]
    assert one.name == "chess club"
    assert one.topic == "games-sci-fi" and one.category == 11
    assert one.rating is None and one.members is None          # zeros become null
    assert one.created == dt.datetime(2017, 7, 14, 2, 40)
    assert one.organizer == 77 and one.tags == ["chess", "board-games"]
    assert one.description == "play chess"
    assert got[4].description == "" and got[4].rating is None and got[4].topic == "tech"
    mapped = E.load_entity(spark, data_dir, "group", cats, unmapped="drop", on_error="drop")
    assert {r.group_id for r in mapped.collect()} == {1, 4}
    with pytest.raises(Exception):
        E.load_entity(spark, data_dir, "group", cats, unmapped="error", on_error="drop").collect()
    with pytest.raises(Exception):
        category_topics(spark.createDataFrame([(7,)], "category int"), cats).collect()


def test_events_venues_rsvps(spark, data_dir):
    ev = {r.event_id: r for r in E.load_entity(spark, data_dir, "event").collect()}
    a1 = ev["a1"]
    assert a1.rating is None and a1.rating_count is None and a1.yes_rsvp == 12
    assert a1.hosts == [1, 2] and a1.venue_id == 5 and a1.group_id == 1
    assert a1.time == dt.datetime(2024, 3, 10, 6, 30) and a1.event_time_stamp == 1710052200
    assert ev["a2"].venue_id is None
    assert ev["a3"].time is None and ev["a3"].event_time_stamp is None
    ve = {r.venue_id: r for r in E.load_entity(spark, data_dir, "venue").collect()}
    assert ve[5].rating is None and ve[5].rating_count == 3 and ve[5].address == "1 Main St"
    rs = E.load_entity(spark, data_dir, "rsvp").first()
    assert rs.member_id == 3 and rs.event_id == "a1" and rs.rsvp_mtime_stamp == 1500000001


def test_events_to_local_time_across_dst(spark, data_dir):
    groups = E.load_entity(spark, data_dir, "group", L.category_topics(spark), on_error="drop")
    eti = event_time_info(E.load_entity(spark, data_dir, "event"), groups)
    got = {r.event_id: r.hour for r in eti.collect()}
    assert got == {"a1": 1, "a2": 3, "a3": None}   # 01:30 EST, then 03:30 EDT


def test_parse_lines_rejects_malformed(spark):
    lines = spark.createDataFrame([(json.dumps(EVENTS[0]), 1), ("{oops", 2), ("", 3), (None, 4)], "value string, n int")
    typed = E.typed_event(E.parse_lines(lines, "event", on_error="drop"))
    assert [r.event_id for r in typed.collect()] == ["a1"]
    assert sorted(r.n for r in E.rejected_lines(lines, "event").collect()) == [2, 3, 4]
    with pytest.raises(Exception):
        E.parse_lines(lines, "event").collect()
    assert E.parse_lines(lines.filter("n = 1"), "event").count() == 1


def test_fractional_counts_are_cut_not_rejected(spark, tmpdir_path):
    write_lines(tmpdir_path, "venues", [{"id": 2, "rating_count": 3.5}, {"id": 3, "rating_count": 7}])
    got = {r.venue_id: r.rating_count for r in E.load_entity(spark, tmpdir_path, "venue").collect()}
    assert got == {2: 3, 3: 7}


def test_lookups(spark, tmpdir_path):
    assert L.cities(spark).count() == 30
    assert L.category_topics(spark).count() == 33
    assert L.topics(spark, topic_num=5).count() == 5
    p = os.path.join(tmpdir_path, "cats.txt")
    with open(p, "w") as f:
        f.write("1\tarts\n2   career\n\n")
    assert sorted(tuple(r) for r in L.category_topics(spark, p).collect()) == [(1, "arts"), (2, "career")]
    p = os.path.join(tmpdir_path, "topics.txt")
    with open(p, "w") as f:
        f.write("career-business, 0\ntech, 1\n")
    assert [tuple(r) for r in L.topic_ids(spark, p).orderBy("topic_id").collect()] == \
        [("career-business", 0), ("tech", 1)]
    p = os.path.join(tmpdir_path, "stop.txt")
    with open(p, "w") as f:
        f.write("they\nthem\nthey\n")
    assert L.stop_words(spark, p).count() == 2
    p = os.path.join(tmpdir_path, "vec.txt")
    with open(p, "w") as f:
        f.write("hello 0.1 0.2 0.3\nworld 1 2 3\n")
    vec = {r.word: r.vec for r in L.word_vectors(spark, p, dim=3).collect()}
    assert vec["world"] == [1.0, 2.0, 3.0]


def test_sinks_partition_and_read_back(spark, tmpdir_path):
    df = spark.createDataFrame([("daily", "NYC", "tech", 0, 3), ("yearly", "NYC", "tech", 2024, 5)],
                               "grain string, city string, topic string, bucket int, n long")
    path = os.path.join(tmpdir_path, "occ")
    SK.write_occurrence(df, path)
    assert os.path.isdir(os.path.join(path, "grain=daily"))
    assert SK.read_occurrence(spark, path, "yearly").first().n == 5
    vpath = os.path.join(tmpdir_path, "venues")
    SK.write_by_city(df.drop("grain"), vpath)
    assert SK.read_city(spark, vpath, "NYC").count() == 2
    mpath = os.path.join(tmpdir_path, "metrics")
    m = spark.createDataFrame([(5, "MNB", 0.8, 0.79)], "topic_num int, model string, f1 double, acc double")
    SK.write_metrics(m, mpath)
    assert tuple(SK.read_metrics(spark, mpath).first()) == (5, "MNB", 0.8, 0.79)


def test_rechunk(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "raw.json")
    with open(src, "w") as f:
        for i in range(25):
            f.write(json.dumps({"id": i}) + "\n")
    out = os.path.join(tmpdir_path, "chunks")
    E.rechunk_lines(spark, src, out, part_num=10)
    assert spark.read.text(out).count() == 25
    E.rechunk_lines(spark, src, out, part_num=10, max_num=20)
    files = [f for f in os.listdir(out) if f.endswith(".gz")]
    assert len(files) == 2
    assert spark.read.text(out).count() == 20


def test_rechunk_keeps_the_order_of_files_and_lines(spark, tmpdir_path):
    import gzip
    src = os.path.join(tmpdir_path, "raw")
    os.makedirs(src)
    every = []
    for f in range(4):
        rows = [json.dumps({"file": f, "line": i, "pad": "x" * (i % 50)}) for i in range(130 + f)]
        every += rows
        with open(os.path.join(src, f"part-{f}.json"), "w") as out:
            out.write("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # several splits a file
    try:
        for most in (None, 300, 7):
            out = os.path.join(tmpdir_path, f"out-{most}")
            E.rechunk_lines(spark, src, out, part_num=40, max_num=most)
            want = every[:most]
            files = []
            for f in os.listdir(out):
                if f.endswith(".gz"):
                    with gzip.open(os.path.join(out, f), "rt") as g:
                        files.append(g.read().splitlines())
            files.sort(key=lambda x: want.index(x[0]))
            assert files == [want[i:i + 40] for i in range(0, len(want), 40)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_city_topic_and_corpus_sinks(spark, tmpdir_path):
    eti = spark.createDataFrame([("e1", "NYC", "tech", 2024), ("e2", "NYC", "food", 2024),
                                 ("e3", "LA", "tech", 2023)],
                                "event_id string, city string, topic string, year int")
    path = os.path.join(tmpdir_path, "ct")
    SK.write_city_topic(eti, path)
    assert os.path.isdir(os.path.join(path, "city=NYC", "topic=tech"))
    assert [r.event_id for r in SK.read_city_topic(spark, path, "NYC", "tech").collect()] == ["e1"]
    corp = spark.createDataFrame([(1, "a", 1, "train", "x y"), (2, "b", 2, "test", "z w"), (3, "c", 7, "train", "x y")],
                                 "doc_id long, topic string, rank int, split string, text string")
    cpath = os.path.join(tmpdir_path, "corp")
    SK.write_corpora(corp, cpath)
    assert [(r.doc_id, r.label) for r in SK.read_corpus(spark, cpath, "train", 5).collect()] == [(1, 0)]
    assert SK.read_corpus(spark, cpath, "train", 10).count() == 2
    assert SK.read_corpus(spark, cpath, "test", 1).count() == 0


def test_sinks_write_few_files(spark, tmpdir_path):
    """Many tasks holding every key leave one file per key, not one per task and key."""
    df = spark.range(4000).repartition(40).selectExpr("concat('c', id % 5) AS city", "concat('t', id % 4) AS topic", "id AS event_id")
    path = os.path.join(tmpdir_path, "ct")
    SK.write_city_topic(df, path)
    files = [f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
    assert len(files) == 20 and spark.read.parquet(path).count() == 4000


def test_dedupe_keeps_one_row_per_id(spark, tmpdir_path):
    write_lines(tmpdir_path, "venues", VENUES + [VENUES[0]])
    assert E.load_entity(spark, tmpdir_path, "venue").count() == 3
    assert E.load_entity(spark, tmpdir_path, "venue", dedupe=True).count() == 2


def test_gzip_chunks_load_as_entities(spark, tmpdir_path):
    src = write_lines(tmpdir_path, "raw_events", [dict(EVENTS[0], id=f"x{i}") for i in range(12)])
    E.rechunk_lines(spark, src, os.path.join(tmpdir_path, "data", "events"), part_num=5, max_num=None)
    assert any(f.endswith(".gz") for f in os.listdir(os.path.join(tmpdir_path, "data", "events")))
    ev = E.load_entity(spark, os.path.join(tmpdir_path, "data"), "event")
    assert ev.count() == 12 and ev.filter("hosts = array(1L, 2L)").count() == 12
