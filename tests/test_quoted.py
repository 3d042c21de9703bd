"""Quoted CSV read in parallel against one reader over the whole file, cut at any byte."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from awardgrid.sources import feeds, quoted

FEED = 'id,title,note\r\n1,"two\nlines","say ""no"", or\n\n""yes"""\n2,plain,5" pipe\n\n3,"é, ""ß""",\n4,"a\r\nb",x\n5,"long ' + "line\n" * 30 + 'end",z\n1,again,"last, of 1"\n6,"closed" open,"q"\n7,"","never'


def states(line, inside):
    """A plain state machine over characters."""
    state = "Q" if inside else "S"
    for c in line:
        if state == "Q":
            state = "E" if c == '"' else "Q"
        elif c == ",":
            state = "S"
        elif state == "S":
            state = "Q" if c == '"' else "U"
        elif state == "E":
            state = "Q" if c == '"' else "U"
    return state == "Q"


def test_line_ends():
    r = random.Random(3)
    for _ in range(4000):
        line = "".join(r.choices('",ab ', k=r.randint(0, 14)))
        for inside in (False, True):
            assert quoted.ends_inside(line, inside) == states(line, inside), (line, inside)


def plain_records(text):
    out, held, inside = [], [], False
    for line in text.split("\n") if not text.endswith("\n") else text[:-1].split("\n"):
        held.append(line)
        inside = states(line, inside)
        if not inside:
            out.append("\n".join(held))
            held = []
    out += ["\n".join(held)] if held else []
    return [y for x in out if (y := x.removesuffix("\r"))]


@pytest.mark.parametrize("most_broadcast", [1_000_000, 0])
def test_records_cut_at_any_byte(spark, tmp_path, most_broadcast):
    r = random.Random(7)
    some = "".join(r.choice(['"', ",", "\n", "a", '""', "é", '"\n', ',"']) for _ in range(250))
    for k, text in enumerate((FEED, some)):
        path = tmp_path / f"feed{k}.csv"
        path.write_bytes(text.encode())
        try:
            for size in (len(text) // 11,) if most_broadcast else (len(text) // 5,):
                spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
                spark.conf.set("spark.sql.files.openCostInBytes", "0")
                spark.conf.set("spark.sql.files.minPartitionNum", "1")
                rows = quoted.read_records(spark, str(path), most_broadcast).orderBy("position").collect()
                assert [x.record for x in rows] == plain_records(text), (k, size)
        finally:
            for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
                spark.conf.unset(f"spark.sql.files.{key}")


def test_feed_equals_readers_of_the_whole(spark, tmp_path):
    """A reader of the whole file, and Python's; a stray quote in an unquoted field is a character, as Python's has it."""
    rows = {}
    for name, text in (("plain", FEED.replace("note\r\n", "note\n").replace('5" pipe', "5 pipe").replace('"closed" open', '"closed"').replace(',"never', ',"ever"')), ("stray", FEED.replace('"closed" open', '"closed"'))):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(("\ufeff" + text).encode())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
        try:
            rows[name] = [tuple(x)[:3] for x in feeds.read_feed(spark, str(path), "at").orderBy("at").collect()]
            if name == "plain":
                kept = {x.reference: x.title for x in feeds.read_notices(spark, str(path), {"reference": "id", "title": "title"}).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        mine = [x for x in csv.reader(io.StringIO(text, newline="")) if x][1:]
        assert rows[name] == [tuple(v if v.strip() else None for v in x) for x in mine]
    whole = spark.read.options(header=True, multiLine=True, escape='"', quote='"').csv(str(tmp_path / "plain.csv"))
    assert [tuple(v and v.replace("\r\n", "\n") for v in x) for x in rows["plain"]] == [tuple(v.replace("\r\n", "\n") if v and v.strip() else None for v in x) for x in whole.collect()]
    assert kept["1"] == "again" and len(kept) == 7


def test_several_files_and_none(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text(f'a,b\n{k},"x\ny{k}"\n')
    rows = feeds.read_feed(spark, str(tmp_path), "at").orderBy("at").collect()
    assert [(x.a, x.b) for x in rows] == [(str(k), f"x\ny{k}") for k in range(3)]
    (tmp_path / "none.txt").write_text("")
    with pytest.raises(ValueError):
        feeds.read_feed(spark, str(tmp_path / "none.txt"))
    (tmp_path / "head.txt").write_text("a,b\n")
    assert feeds.read_feed(spark, str(tmp_path / "head.txt")).where(F.lit(True)).count() == 0
