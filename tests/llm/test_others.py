import hashlib
import math
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from eventloom.llm import language, media, mixing, queries, sharding

SF = "/root/testdata/sf0.001"

# sharding


def plain_shard(key, weights):
    def score(s, w):
        u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return w / -math.log(u)

    return max(range(len(weights)), key=lambda s: (score(s, weights[s]), -s))


def test_sharding(spark):
    df = spark.range(400).withColumn("shard", F.lit("old"))
    weights = [1.0, 2.0, 0.5, 1.0]
    got = sharding.shard_by_key(df, "id", weights, grown=[1.5]).collect()
    for r in got:
        assert r.shard == plain_shard(r.id, weights) and r.grown_shard == plain_shard(r.id, [*weights, 1.5])
        assert r.grown_shard in (r.shard, 4)
    share = [sum(r.shard == s for r in got) / 400 for s in range(4)]
    assert all(abs(x - w / 4.5) < 0.08 for x, w in zip(share, weights, strict=True))
    for wrong in ([], [1.0, 0.0]):
        with pytest.raises(ValueError):
            sharding.shard_by_key(df, "id", wrong)


def test_shards_of_texts(spark):
    rows = [(i, f"text {i % 7} é", "x") for i in range(200)] + [(None, None, "x"), (5, None, "x"), (5, None, "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    got = sharding.text_shards(df, "doc_id", "text", [1.0] * 8, [1.0]).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in got if r.doc_id != 5}
    assert sizes[8] == (len("text 1 é".encode()) + 16, zlib.crc32("text 1 é".encode())) and sizes[None] == (16, 0)
    assert len({r.shard for r in got if r.doc_id == 5}) == 1 and {r.law for r in got} == {"key"}
    assert sharding.text_shards(df.limit(0), "doc_id", "text", [1.0, 1.0]).count() == 0


# mixing


def test_every_block_has_one_slot():
    rng = random.Random(4)
    for _ in range(20):
        blocks = {(f"s{i}" if i else None): rng.choice([0, 1, 3, 50, 900]) for i in range(rng.randint(1, 9))}
        slots = mixing.schedule(blocks, {s: rng.random() + 0.1 for s in blocks})
        assert {s: slots.count(s) for s in blocks} == blocks and len(slots) == sum(blocks.values())
    assert mixing.schedule({}, {}) == []


@pytest.mark.parametrize("weights", [[1.0] * 3, [1.0] * 20, [0.0001, 0.3, 0.6999], [2**0.5, 3**0.5, 5**0.5], [0.5, 0.3, 0.15, 0.05], [1.0] * 10 + [0.01]])
def test_less_than_one_block_from_the_target(weights):
    """Over 100,000 slots, against the weights themselves."""
    blocks = {f"s{i}": int(100_000 * w / sum(weights)) + 2 for i, w in enumerate(weights)}
    share = mixing.exact_shares(weights)
    done, total = [0] * len(weights), sum(share)
    for t, s in enumerate(mixing.schedule(blocks, {f"s{i}": w for i, w in enumerate(weights)})[:100_000], 1):
        done[int(s[1:])] += 1
        if t % 7 == 0 or t < 3000:
            assert all(abs(n * total - t * w) < total for n, w in zip(done, share, strict=True))


def test_the_schedule_is_bounded():
    for rows in (0, 1, 64, 10**6, 10**12):
        size = mixing.rows_of_block(rows)
        assert size >= 64 and -(-rows // size) <= mixing.SLOTS


def plain_mixture(rows, size=64):
    """Slots one by one from windows of exact fractions; rows: (key, source). key -> (rank, block, slot, position)."""
    from fractions import Fraction

    members = {}
    for key, source in rows:
        members.setdefault(source, []).append(key)
    for own in members.values():
        own.sort(key=lambda k: (hashlib.md5(str(k).encode()).digest()[0], k))
    weight = {s: math.isqrt(len(own)) for s, own in members.items()}
    left = {s: -(-len(own) // size) for s, own in members.items()}
    order = sorted(members, key=lambda s: (s is not None, s or ""))
    done, since, start, slot, place = dict.fromkeys(order, 0), dict.fromkeys(order, 0), 0, 0, {}
    while any(left.values()):
        live = [s for s in order if left[s]]
        w = {s: Fraction(weight[s], sum(weight[x] for x in live)) for s in live}
        ready = [s for s in live if math.floor(since[s] / w[s]) <= slot - start]
        s = min(ready, key=lambda x: (math.ceil((since[x] + 1) / w[x]), order.index(x)))
        place[s, done[s]] = slot
        done[s], since[s], left[s], slot = done[s] + 1, since[s] + 1, left[s] - 1, slot + 1
        if not left[s]:
            start, since = slot, dict.fromkeys(order, 0)
    return {k: (r, r // size, place[s, r // size], place[s, r // size] * size + r % size) for s, own in members.items() for r, k in enumerate(own)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_mixing_of_documents(spark):
    rows = [(r.doc_id, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()]
    got = queries.op10_mixing(spark, SF).collect()
    assert {r.doc_id: (r.source_rank, r.block, r.slot, r.position) for r in got} == plain_mixture(rows) and len(got) == len(rows)


def test_mixed(spark):
    rows = [(i, f"s{min(i % 10, 3)}" if i % 10 else None, "x") for i in range(1000)] + [(3, "s3", "x"), (None, "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    weights = {None: 1.0, "s1": 1.0, "s2": 2.0, "s3": 4.0}
    got = mixing.mixed(df, "doc_id", "source", weights, block_rows=10).orderBy("position").collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    for n in (200, 320):  # while no source has run dry
        for s, w in weights.items():
            assert abs(sum(r.source == s for r in got[:n]) - n * w / 8) <= 10 * 1.3
    ranks = {}
    for r in got:
        ranks.setdefault(r.source, []).append(r.source_rank)
    assert all(x == list(range(len(x))) for x in ranks.values())
    assert mixing.mixed(df.limit(0), "doc_id", "source").count() == 0
    assert mixing.mixed(df, "doc_id", "source").count() == len(rows)
    for wrong in (lambda: mixing.mixed(df, "doc_id", "source", {"s1": 1.0}), lambda: mixing.mixed(df.drop("slot").withColumnRenamed("doc_id", "slot"), "slot", "source")):
        with pytest.raises(ValueError):
            wrong()
    some = mixing.mixed(df, "doc_id", "source", slots=4).collect()  # blocks of a quarter of the rows
    assert len(some) == len(rows) and max(r.slot for r in some) <= 4 + 4 and {r.position // r.slot if r.slot and r.source_rank % 251 == 0 else 251 for r in some} == {251}


# language


VOICES = {"xx": "aeiou", "yy": "bcdfg", "zz": "äöüß"}


def sentences(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(VOICES))
        out.append((i, " ".join("".join(rng.choices(VOICES[lang] + "nrst", k=5)) for _ in range(rng.randint(3, 40))), lang))
    return out


def test_language(spark):
    rows = sentences(1, 400) + [(900, None, "xx"), (901, "12 34 !?", "yy"), (902, "", None), (903, "aeiou", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.train(df, "doc_id", "text", "lang", rows=300)
    got = {r.doc_id: r for r in language.language_columns(df, "text", model).withColumn("held", language.held_out("doc_id")).collect()}
    assert len(got) == len(rows)
    held = [r for r in got.values() if r.held and r.lang and r.doc_id < 900]
    assert len(held) > 50 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(r.held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[903].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got.values())
    assert language.language_columns(df.limit(0), "text", model).count() == 0


@pytest.mark.parametrize("case", ["empty", "no labels", "all held out", "no letters"])
def test_nothing_to_learn_from(spark, case):
    rows = [r for r in sentences(1, 60) if case != "all held out" or zlib.crc32(str(r[0]).encode()) % 4 == 2]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = {"empty": df.limit(0), "no labels": df.withColumn("lang", F.lit(None).cast("string")), "all held out": df, "no letters": df.withColumn("text", F.lit("12 3"))}[case]
    model = language.train(df, "doc_id", "text", "lang")
    assert model.langs == []
    assert {(r.lang_pred, r.score, r.accepted) for r in language.language_columns(df, "text", model).collect()} <= {("und", 0.0, False)}


def test_language_is_learnt_from_whole_texts(spark):
    """The first 5000 characters of every text are the same; what tells languages apart comes after."""
    rows = [(i, "the same head " * 360 + t * 20, lang) for i, t, lang in sentences(3, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.train(df, "doc_id", "text", "lang")
    held = [r for r in language.language_columns(df, "text", model).withColumn("held", language.held_out("doc_id")).collect() if r.held]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    few = language.train(df, "doc_id", "text", "lang", sample_bytes=200_000)  # rows that don't fit are passed over
    assert few.langs


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_languages_of_documents(spark):
    """Held-out accuracy of the query, for each language."""
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    right = {}
    for r in queries.op5_language_id(spark, SF).collect():
        if r.held_out and labels[r.doc_id] and r.lang_pred != "und":
            right.setdefault(labels[r.doc_id], []).append(r.lang_pred == labels[r.doc_id])
    assert len(right) == 4 and all(sum(x) / len(x) > 0.9 for x in right.values()), {k: (sum(x), len(x)) for k, x in right.items()}


def test_scores_are_calibrated_and_reject():
    rows = sentences(2, 300)
    rng = random.Random(3)
    langs = [lang if rng.random() < 0.8 else rng.choice(sorted(VOICES)) for _, _, lang in rows]  # labels that can't be learnt
    model = language.fit([t for _, t, _ in rows], langs, min_score=0.99)
    fresh = sentences(5, 200)
    _, scores, accepted = model.predict([t for _, t, _ in fresh])
    assert 0.5 < sum(scores) / len(scores) < 0.97 and sum(accepted) < 150
    texts = ["aeiou aeiou", None, "x", "aeiou aeiou", "é"]
    one, both = model.predict(texts), model.predict(texts[::-1])
    assert one[1] == both[1][::-1] and one[1][0] == one[1][3]
    assert model.predict([]) == ([], [], [])


# media


def test_store_and_read_back(spark):
    texts = ["", None, "short", "é" * 288, "x" * 577, "long " * 20_000, "short"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in media.stored_columns(df, "text", with_media=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = media.padded(raw)
        assert len(payload) % 576 == 0 and payload.startswith(raw) and len(payload) - len(raw) <= 576
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert got[2].media == got[6].media and got[2].feature == got[6].feature
    made = media.stored_columns(df, "text", ["doc_id"], True).withColumn("codec", F.lit(1))
    probed = {r.doc_id: r for r in media.media_columns(made, "media").collect()}
    for i, r in probed.items():
        frames = r.payload_bytes // 576
        assert (r.codec, r.width, r.height, r.n_samples, r.media_error) == ("raw", 24, 24, frames, None)
        assert r.duration_s == pytest.approx(frames / 25) and len(r.keyframes) == -(-frames // 8)
        assert all(bytes(got[i].media[k.offset : k.offset + k["size"]]) == media.padded((texts[i] or "").encode())[n * 8 * 576 :][:576] for n, k in enumerate(r.keyframes))
    assert media.stored_columns(df.limit(0), "text").count() == 0


def test_other_boxes_and_broken_files(spark):
    good = media.container_of(b"\x01" * 576 * 20)
    moov = good.index(b"moov") - 4
    wide = good[:moov].replace(struct.pack(">I", 576 * 20 + 8) + b"mdat", struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 576 * 20 + 16)) + good[moov:]
    assert media.probe(wide)[0].codec == "raw"
    last = good[:moov] + struct.pack(">I", 0) + good[moov + 4 :]  # the last box reaches to the end
    assert len(media.probe(last)[0].samples) == 20
    no_table = good.replace(b"stss", b"free")
    assert all(key for _, _, key in media.probe(no_table)[0].samples)
    assert media.probe(good)[0].duration == 20 * media.TICKS
    broken = [b"not a file at all", good[:-5], good[:40], good.replace(b"stco", b"free")[: moov + 30], struct.pack(">I4s", 8, b"free")]
    rows = [(i, x) for i, x in enumerate([*broken, None, b""])]
    got = {r.i: r for r in media.media_columns(spark.createDataFrame(rows, "i int, b binary"), "b").collect()}
    assert all(got[i].media_error for i in (0, 1, 2, 3, 4, 6)) and got[5].media_error is None and got[5].codec is None
    rng = random.Random(1)
    for _ in range(300):  # damage never does more than raise a ValueError
        damaged = bytearray(good)
        for _ in range(3):
            damaged[rng.randrange(moov, len(good))] = rng.randrange(256)
        try:
            media.probe(bytes(damaged))
        except (ValueError, struct.error, IndexError):
            pass
    with pytest.raises(ValueError):
        media.container_of(b"")


def box(kind, *parts):
    return media._box(kind, *parts)


def full(kind, *parts, **more):
    return media._full(kind, *parts, **more)


def u32(*numbers):
    return struct.pack(f">{len(numbers)}I", *numbers)


def track(number, handler, codec, timescale, *tables):
    """A trak box with a header of the older form and these sample tables."""
    tkhd = full(b"tkhd", u32(0, 0, number, 0, 777), bytes(60))
    mdhd = full(b"mdhd", u32(0, 0, timescale, 777), bytes(4))
    hdlr = full(b"hdlr", bytes(4), handler, bytes(13))
    entry = box(codec, bytes(24), struct.pack(">HH", 64, 48), bytes(20)) if handler == b"vide" else box(codec, bytes(28))
    stbl = box(b"stbl", full(b"stsd", u32(1), entry), *tables)
    return box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, box(b"minf", stbl)))


def plain_tables(sizes, ticks, offset, keys=None, size_box=None):
    """Tables of one chunk with these samples."""
    stss = [full(b"stss", u32(len(keys), *keys))] if keys is not None else []
    return [full(b"stts", u32(len(ticks), *(x for n in ticks for x in n))), *stss, full(b"stsc", u32(1, 1, len(sizes), 1)), size_box or full(b"stsz", u32(0, len(sizes), *sizes)), full(b"stco", u32(1, offset))]


def test_tracks_with_uneven_durations_and_compact_sizes(spark):
    """A sound track first, then video with B-frames (composition offsets), sizes of 4, 8 and 16 bits."""
    for bits, form in ((4, None), (8, ">3B"), (16, ">3H")):
        sizes = (7, 15, 3)
        packed = bytes([7 << 4 | 15, 3 << 4]) if bits == 4 else struct.pack(form, *sizes)
        stz2 = full(b"stz2", u32(bits, 3), packed)
        ctts = full(b"ctts", u32(3, 1, 20, 1, 40, 1, 0))
        head = box(b"ftyp", b"isom", u32(0))
        sound = track(1, b"soun", b"mp4a", 48_000, *plain_tables([4, 4], [(1, 1024), (1, 500)], len(head) + 8))
        video = track(2, b"vide", b"avc1", 600, *plain_tables(sizes, [(2, 20), (1, 35)], len(head) + 16, [1, 3], stz2), ctts)
        data = head + box(b"mdat", bytes(8), bytes(range(25))) + box(b"moov", sound, video)
        one, two = media.probe(data)
        assert (one.handler, one.codec, one.duration, len(one.samples)) == ("soun", "mp4a", 1524, 2)
        at = len(head) + 16
        assert (two.handler, two.codec, two.duration, two.width, two.height) == ("vide", "avc1", 75, 64, 48)
        assert two.samples == [(at, 7, True), (at + 7, 15, False), (at + 22, 3, True)]
        row = media.media_columns(spark.createDataFrame([(data,)], "b binary"), "b").first()
        assert (row.codec, row.n_samples, row.media_error) == ("avc1", 3, None) and row.duration_s == pytest.approx(0.125)
        assert [(t.number, t.handler, t.n_samples, len(t.keyframes)) for t in row.tracks] == [(1, "soun", 2, 2), (2, "vide", 3, 2)]


def fragmented(tfhd_flags=0x20000, tfhd_more=b""):
    """A header without samples, then two fragments: defaults of trex, of tfhd and values of each sample."""
    empty = [full(b"stts", u32(0)), full(b"stsc", u32(0)), full(b"stsz", u32(0, 0)), full(b"stco", u32(0))]
    trex = full(b"trex", u32(1, 1, 100, 5, media.DEPENDS))
    head = box(b"ftyp", b"iso5", u32(0)) + box(b"moov", track(1, b"vide", b"hvc1", 1000, *empty), box(b"mvex", trex))

    def moof(*truns, flags=tfhd_flags, more=tfhd_more):
        return box(b"moof", full(b"mfhd", u32(1)), box(b"traf", full(b"tfhd", u32(1), more, flags=flags), *truns))

    def first(offset):  # three samples: the first a keyframe, sizes and durations the defaults
        return moof(full(b"trun", u32(3, offset, 0), flags=0x1 | 0x4))

    def second(offset):  # two samples with values of their own, and a second run that goes on where the first ended
        return moof(full(b"trun", u32(2, offset, 40, 6, 0, 60, 7, media.DEPENDS), flags=0x1 | 0x100 | 0x200 | 0x400), full(b"trun", u32(1)))

    a, b = first(len(first(0)) + 8), second(len(second(0)) + 8)
    return head, head + a + box(b"mdat", bytes(15)) + b + box(b"mdat", bytes(18))


def test_fragments(spark):
    head, data = fragmented()
    (t,) = media.probe(data)
    one = data.index(b"mdat") + 4
    two = data.index(b"mdat", one) + 4
    assert t.samples == [(one, 5, True), (one + 5, 5, False), (one + 10, 5, False), (two, 6, True), (two + 6, 7, False), (two + 13, 5, False)]
    assert t.duration == 3 * 100 + 40 + 60 + 100 and t.seconds == pytest.approx(0.5)
    (t,) = media.probe(head)
    assert (t.samples, t.duration) == ([], 777)
    bad = [data[:-1], data.replace(b"tfhd" + u32(0x20000, 1), b"tfhd" + u32(0x20000, 9)), data.replace(b"tfhd", b"free")]
    rows = media.media_columns(spark.createDataFrame([(i, x) for i, x in enumerate([data, *bad])], "i int, b binary"), "b").orderBy("i").collect()
    assert rows[0].n_samples == 6 and len(rows[0].keyframes) == 2 and all(r.media_error and r.n_samples is None for r in rows[1:])


def test_tables_that_disagree_are_errors():
    good = plain_tables([4, 4], [(2, 10)], 20)
    for tables in ([*good[1:]], [full(b"stts", u32(1, 3, 10)), *good[1:]], [x for x in good if b"stsc" not in x], [x for x in good if b"stco" not in x], [*good[:2], full(b"stz2", u32(12, 2), bytes(8)), good[-1]]):
        with pytest.raises(ValueError):
            media.probe(box(b"ftyp", bytes(40)) + box(b"moov", track(1, b"vide", b"avc1", 10, *tables)))
