"""Vector segments: round trips, damage that names its block, publication by one rename."""

import glob

import pytest

from kelpie.sources import scratch, segments


def vectors(spark, n=25, d=3):
    return spark.createDataFrame([(k, [float(k), k / 2, -1.5][:d]) for k in range(n)], "rowid bigint, vector array<double>").repartition(2)


def shown(df):
    return sorted((r.rowid, tuple(r.vector)) for r in df.collect())


@pytest.fixture
def folder(spark):
    return scratch.folder(spark).removeprefix("file://")


def test_round_trip_with_a_partition_for_each_block(spark, folder):
    df = vectors(spark)
    segments.written(df, folder, profile="p", generation="7", blockRows="4")
    back = segments.read(spark, folder, profile="p", generation="7")
    assert shown(back) == shown(df) and back.rdd.getNumPartitions() == sum(len(segments.header_of(f)[0]["blocks"]) for f in glob.glob(f"{folder}/*.seg")) > 6
    with pytest.raises(Exception, match="profile is p, not q"):
        segments.read(spark, folder, profile="q").count()


def test_a_flipped_byte_names_its_block(spark, folder):
    segments.written(vectors(spark).coalesce(1), folder, blockRows="10")
    (name,) = glob.glob(f"{folder}/*.seg")
    header, base = segments.header_of(name)
    place = base + header["blocks"][1]["offset"] + 3
    raw = bytearray(open(name, "rb").read())
    raw[place] ^= 1
    open(name, "wb").write(raw)
    with pytest.raises(Exception, match="checksum mismatch in block 1"):
        segments.read(spark, folder).collect()
    first = header["blocks"][0]
    assert len(segments.block_of(name, 0, base, first["length"], first["sha256"], 10, 3)[0]) == 10  # the others can be read


@pytest.mark.parametrize(("cut", "message"), [(5, "not a segment"), (40, "invalid header length|broken header"), (-2, "truncated segment")])
def test_a_cut_file_is_an_error(spark, folder, cut, message):
    segments.written(vectors(spark).coalesce(1), folder)
    (name,) = glob.glob(f"{folder}/*.seg")
    raw = open(name, "rb").read()[:cut]
    open(name, "wb").write(raw)
    with pytest.raises(Exception, match=message):
        segments.read(spark, folder).collect()


def test_only_what_is_published_is_read(spark, folder):
    old, new = vectors(spark, 5), vectors(spark, 9)
    segments.written(old, folder)
    segments.written(new, folder, publish="false", manifest="next.json")
    assert shown(segments.read(spark, folder)) == shown(old) and shown(segments.read(spark, folder, manifest="next.json")) == shown(new)
    segments.publish(folder, "next.json")
    assert shown(segments.read(spark, folder)) == shown(new)


def test_migration_publishes_only_an_equal_copy(spark, folder, monkeypatch):
    segments.written(vectors(spark), f"{folder}/a", profile="p", generation="3")
    manifest = segments.migrated(spark, f"{folder}/a", f"{folder}/b", blockRows="3")
    assert (manifest["profile"], manifest["generation"], manifest["rows"]) == ("p", "3", 25) and shown(segments.read(spark, f"{folder}/b")) == shown(vectors(spark))
    real = segments.content
    seen = []
    monkeypatch.setattr(segments, "content", lambda df: seen.append(1) or (real(df) if len(seen) < 2 else (0, "")))
    with pytest.raises(ValueError, match="differs"):
        segments.migrated(spark, f"{folder}/a", f"{folder}/c")
    with pytest.raises(Exception, match="(?i)current|no such file"):
        segments.read(spark, f"{folder}/c").count()


def test_rows_that_are_refused_and_an_empty_table(spark, folder):
    for row in ((None, [1.0]), (1, None), (1, [float("nan")])):
        with pytest.raises(Exception, match="finite vectors of one dimension"):
            segments.written(spark.createDataFrame([row, (2, [1.0])], "rowid bigint, vector array<double>").coalesce(1), folder)
    segments.written(spark.createDataFrame([], "rowid bigint, vector array<double>"), f"{folder}/none")
    assert segments.read(spark, f"{folder}/none").count() == 0
