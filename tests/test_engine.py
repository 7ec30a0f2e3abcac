import datetime
import random
import struct
import sys
import time
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fathomix import engine as engine_module, models
from fathomix.config import Config, LoadShedding
from fathomix.engine import Engine
from fathomix.monitor import Gate, HostSampler, Sample, high_reason
from fathomix.sources.extract import Readers

# Readers of this module go to workers, which cannot import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
from fathomix.streaming.index import debounced_stream, distinct_paths, drained, state_in_rocksdb, table_stream


def test_index_and_search(spark, tmp_path):
    root = tmp_path / "files"
    (root / ".ssh").mkdir(parents=True)
    (root / "meeting.txt").write_text("客户 会议 录音 报价 讨论")
    (root / "random.txt").write_text("unrelated content")
    (root / ".ssh/id_rsa").write_text("secret")
    (root / ".ssh/note.txt").write_text("报价")
    with zipfile.ZipFile(root / "a.zip", "w") as z:
        z.writestr("docs/inner.md", "a zebra lives in the archive")
    engine = Engine(spark, f"file://{tmp_path}/index", Config())
    assert engine.index([str(root)]) == {"indexed": 4}
    rows = engine.search("报价", top=5).collect()
    assert rows[0].path.endswith("meeting.txt") and "fts" in rows[0].sources
    assert [r.path.rsplit("/", 1)[-1] for r in engine.search("zebra", top=1).collect()] == ["inner.md"]
    before = sorted(map(tuple, engine.table("files").drop("updated_at").collect()))
    assert engine.index([str(root)]) == {"indexed": 4}
    assert sorted(map(tuple, engine.table("files").drop("updated_at").collect())) == before
    time.sleep(0.01)
    (root / "random.txt").write_text("now about zebras and a zebra")
    engine.index([str(root)])
    ids = {r.path: r.file_id for r in engine.table("files").collect()}
    assert all(ids[t[1]] == t[0] for t in before)
    assert engine.table("chunks").count() == engine.table("vectors").count() == 3
    assert {r.path.rsplit("/", 1)[-1] for r in engine.search("zebra", type_filter="text", path_glob="*/random*").collect()} == {"random.txt"}
    assert engine.search("zebra", since="2999-01-01").count() == 0
    engine.config.search.nearest = "lsh"
    assert engine.search("zebra").first().path.endswith(("random.txt", "inner.md"))
    engine.config.search.nearest = "exact"
    told = engine.search("x", ask=lambda p: 'Sure {"query": "zebra", "type": "nonsense", "since": "bad"} ').collect()
    assert any(r.path.endswith("random.txt") for r in told)
    engine.wipe()
    assert engine.table("files").count() == 0


def test_debounced_stream(spark, tmp_path):
    """Over several batches: state goes on from one to the next."""
    rows = [(1, i, float(i), i < 10) for i in range(40)] + [(2, i, float(i), False) for i in range(5)]
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], "key long, event_id long, at_s double, high boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
        time.sleep(0.02)
    with state_in_rocksdb(spark):
        out = drained(debounced_stream(table_stream(spark, str(tmp_path / "in.parquet"), 1), 4.0, 6.0)).collect()
    assert len(out) == 45
    got = {(r.key, r.at_s): r.paused for r in out}
    assert {at for (k, at), p in got.items() if p and k == 1} == {float(i) for i in range(4, 16)}
    assert not any(p for (k, _), p in got.items() if k == 2)


def test_distinct_paths(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("a", t), ("a", t), ("b", t)], "path string, at timestamp").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("path string, at timestamp").parquet(str(tmp_path / "in"))
    q = distinct_paths(source).writeStream.format("memory").queryName("paths").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.path for r in spark.table("paths").select(F.col("path")).collect()) == ["a", "b"]


def png(color):
    """One pixel, as a file that a reader of headers knows."""
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 4, 3) + color


def fake_pdf(raw):
    if not raw.startswith(b"%PDF"):
        raise ValueError("no pages")
    return raw.decode().removeprefix("%PDF ").split("|")


def fake_frames(raw, suffix, every_s, most):
    return [(int(i * every_s * 1000), x) for i, x in enumerate(raw.split(b"--")[:most])]


def speech():
    return lambda raw: [(0.5, 1.5, f" said {raw.decode()} "), (2.0, 3.0, "\t")]


def shape(raw):
    if not raw.startswith(b"\x89PNG"):
        raise ValueError("no image")
    return 4, 3, raw


@pytest.fixture
def media_root(tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    (root / "good.pdf").write_bytes(b"%PDF first page|a walrus")
    (root / "bad.pdf").write_bytes(b"broken")
    (root / "a.png").write_bytes(png(b"red"))
    (root / "b.png").write_bytes(b"broken")
    (root / "c.mp4").write_bytes(png(b"blue") + b"--junk--" + png(b"green"))
    (root / "d.mp3").write_bytes(b"hippo")
    (root / "e.7z").write_bytes(b"no archive")
    with zipfile.ZipFile(root / "f.zip", "w") as z:
        z.writestr("in/good.pdf", b"%PDF an okapi")
        z.writestr("in/x.unknown", b"?")
    with zipfile.ZipFile(root / "g.zip", "w") as z:
        z.writestr("../evil.txt", b"out")
    return root


def named(df, column="path"):
    return {r[column].rsplit("/", 1)[-1]: r for r in df.collect()}


def test_media_reach_chunks_frames_and_vectors(spark, tmp_path, media_root):
    readers = Readers(fake_pdf, shape, fake_frames, lambda raw, suffix: b"film", speech)
    engine = Engine(spark, f"file://{tmp_path}/index", Config(), readers=readers)
    engine.index([str(media_root)])
    files = named(engine.table("files"))
    assert {n: f.status for n, f in files.items()} == {"good.pdf": "indexed", "bad.pdf": "error", "a.png": "indexed", "b.png": "error", "c.mp4": "indexed", "d.mp3": "indexed", "e.7z": "error", "f.zip": "indexed", "g.zip": "error"} or len(files) == 9
    by_path = {r.path.removeprefix(str(media_root) + "/"): r for r in engine.table("files").collect()}
    assert by_path["f.zip::in/good.pdf"].real_path.endswith("f.zip") and by_path["f.zip::in/good.pdf"].status == "indexed"
    assert "no pages" in by_path["bad.pdf"].error_message and "leaves its folder" in by_path["g.zip"].error_message
    ids = {r.file_id: p for p, r in by_path.items()}
    chunks = sorted((ids[r.file_id], r.chunk_no, r.chunk_type, r.start_offset, r.start_time_ms, r.end_time_ms, r.snippet) for r in engine.table("chunks").collect())
    assert chunks == [
        ("c.mp4", 0, "video_transcript", None, 500, 1500, "said film"),
        ("d.mp3", 0, "audio_segment", None, 500, 1500, "said hippo"),
        ("f.zip::in/good.pdf", 0, "pdf_page", 0, None, None, "an okapi"),
        ("good.pdf", 0, "pdf_page", 0, None, None, "first page"),
        ("good.pdf", 1, "pdf_page", 1, None, None, "a walrus"),
    ]
    frames = sorted((ids[r.file_id], r.frame_no, r.timestamp_ms, r.width, r.height) for r in engine.table("frames").collect())
    assert frames == [("a.png", 0, None, 4, 3), ("c.mp4", 0, 0, 4, 3), ("c.mp4", 1, 4000, 4, 3)]
    vectors = engine.table("vectors").collect()
    assert sorted(r.vector_id for r in vectors) == list(range(1, 9)) and sum(r.space == "image" for r in vectors) == 3
    top = engine.search("walrus", type_filter="pdf").first()
    assert top.path.endswith("/good.pdf") and {"fts", "vector:text"} <= set(top.sources) or top.snippet
    spoken = engine.search("hippo", type_filter="audio").first()
    assert spoken.path.endswith("d.mp3") and spoken.timestamp_ms == 500
    assert engine.search("anything", type_filter="image").first().sources == ["vector:image"]
    assert [r.inner_path for r in engine.table("entries").orderBy("inner_path").collect()] == ["in/good.pdf", "in/x.unknown"]
    state = engine.state()
    assert (state["enqueued"], state["processed"], state["skipped"], state["errors"]) == (9, 6, 0, 4) and state["vector_bytes"] > 0


def test_without_a_transcriber_audio_is_skipped(spark, tmp_path, media_root):
    engine = Engine(spark, f"file://{tmp_path}/index", Config(), readers=Readers(fake_pdf, shape, fake_frames))
    engine.index([str(media_root)])
    files = named(engine.table("files"))
    assert (files["d.mp3"].status, files["d.mp3"].error_message) == ("skipped", "no transcriber") and files["c.mp4"].status == "indexed"
    assert engine.table("chunks").where("chunk_type like '%video%'").count() == 0


def test_runs_add_postings_and_old_versions_go(spark, tmp_path, monkeypatch):
    root = tmp_path / "files"
    root.mkdir()
    for i in range(6):
        (root / f"{i}.txt").write_text(f"common word{i}")
    engine = Engine(spark, f"file://{tmp_path}/index", Config())
    engine.index([str(root)])
    read = lambda q: sorted(r.path.rsplit("/", 1)[-1] for r in engine.search(q, top=50).where("array_contains(sources, 'fts')").collect())
    assert read("common") == [f"{i}.txt" for i in range(6)]
    time.sleep(0.01)
    (root / "0.txt").write_text("something else")
    (root / "7.txt").write_text("common newcomer")
    before = engine.store.manifest()
    assert engine.index([str(root)]) == {"indexed": 7}
    after = engine.store.manifest()
    assert len(after["tables"]["postings"]) == 2 and after["before"] and set(after["before"]) <= {x for t in before["tables"].values() for x in t}
    assert read("common") == ["1.txt", "2.txt", "3.txt", "4.txt", "5.txt", "7.txt"] and read("word0") == [] and read("something") == ["0.txt"]
    fresh = Engine(spark, f"file://{tmp_path}/other", Config())
    fresh.index([str(root)])
    ranks = lambda e: {r.path: round(r.score, 9) for r in e.search("common").collect()}
    assert ranks(engine) == ranks(fresh)
    monkeypatch.setattr(engine_module, "STALE_SHARE", 0.0)
    time.sleep(0.01)
    (root / "1.txt").write_text("word1 alone")
    engine.index([str(root)])
    assert len(engine.store.manifest()["tables"]["postings"]) == 1 and "1.txt" not in read("common")
    # Nothing of the run before the last remains, nor anything of a run alone.
    kept = {x for t in engine.store.manifest()["tables"].values() for x in t} | set(engine.store.manifest()["before"])
    assert {p.name for p in (tmp_path / "index").iterdir() if p.is_dir()} == kept
    assert len(engine.cleanup()) == len(engine.store.manifest()["before"]) and read("alone") == ["1.txt"]
    engine.cleanup(everything=True)
    assert list((tmp_path / "index").iterdir()) == [] and engine.search("common").count() == 0


def test_roots_as_uris(spark, tmp_path):
    root = tmp_path / "files"
    (root / "deep/.ssh").mkdir(parents=True)
    (root / "a.txt").write_text("alpha walrus")
    (root / "deep/b.md").write_text("beta")
    (root / "deep/.ssh/c.txt").write_text("hidden")
    (root / "x.unknown").write_text("?")
    engine = Engine(spark, f"file://{tmp_path}/index", Config())
    assert sorted(r.path for r in engine.scan([f"file://{root}"]).collect()) == [f"{root}/a.txt", f"{root}/deep/b.md"]
    assert engine.index([f"file://{root}"]) == {"indexed": 2} and engine.search("walrus", top=1).first().path == f"{root}/a.txt"
    from fathomix.sources.extract import _bytes

    assert _bytes(f"file://{root}/a.txt") == b"alpha walrus"


def test_batches_are_committed_one_by_one(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for i in range(5):
        (root / f"{i}.txt").write_text(f"common word{i}")
    config = Config()
    config.indexing.batch_files = 2
    engine, commits = Engine(spark, f"file://{tmp_path}/index", config), []
    commit = engine.store.commit
    engine.store.commit = lambda written, state: (commits.append(state["processed"]), commit(written, state))
    assert engine.index([str(root)]) == {"indexed": 5} and commits == [2, 4, 5]
    assert engine.state()["enqueued"] == 5 and engine.search("common").where("array_contains(sources, 'fts')").count() == 5
    assert sorted(r.vector_id for r in engine.table("vectors").collect()) == [1, 2, 3, 4, 5]


def test_a_failed_run_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    root = tmp_path / "files"
    root.mkdir()
    (root / "a.txt").write_text("alpha")
    engine = Engine(spark, f"file://{tmp_path}/index", Config())
    engine.index([str(root)])
    (root / "b.txt").write_text("beta")
    monkeypatch.setattr(engine_module.lexical, "write_index", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.index([str(root)])
    monkeypatch.undo()
    assert engine.table("files").count() == 1 and engine.search("alpha").count() == 1
    assert engine.index([str(root)]) == {"indexed": 2} and engine.search("beta", top=1).first().path.endswith("b.txt")


def test_rerank_and_query_by_a_model(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for i in range(4):
        (root / f"{i}.txt").write_text("zebra " * (i + 1))
    engine = Engine(spark, f"file://{tmp_path}/index", Config())
    engine.index([str(root)])
    plain = [r.path for r in engine.search("zebra").collect()]
    asked = []

    def ask(prompt):
        asked.append(prompt)
        return "no JSON" if len(asked) == 1 else 'Here: {"order": [2, 9, 2, true, 0], "explanations": {"2": " fits ", "1": 5}}'

    rows = engine.search("zebra", ask=ask).collect()
    assert [r.path for r in rows] == [plain[2], plain[0], plain[1], plain[3]] and [r.explanation for r in rows] == ["fits", None, None, None]
    assert plain[1] in asked[1]

    def broken(prompt):
        raise OSError("no server")

    assert [r.path for r in engine.search("zebra", ask=broken).collect()] == plain
    assert [r.path for r in engine.search("zebra", ask=ask, rerank=False).collect()] == plain


def test_a_closed_gate_holds_a_run(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    (root / "a.txt").write_text("alpha")
    clock, told = [0.0], []
    samples = [Sample(99.0, 0.1, 8.0, 8)] * 15 + [Sample(1.0, 0.1, 8.0, 8)] * 400
    engine = Engine(spark, f"file://{tmp_path}/index", Config())
    save = engine.store.save_state
    engine.store.save_state = lambda state: (told.append(dict(state)), save(state))

    def tick(seconds):
        clock[0] += seconds

    gate = Gate(LoadShedding(), lambda: samples.pop(0), lambda: clock[0], tick)
    # Steps of ten seconds until the gate closes, as a run's work would take.
    for _ in range(11):
        gate.look()
        clock[0] += 1.0
    assert gate.paused and gate.reason == "cpu>70%"
    assert engine.index([str(root)], gate) == {"indexed": 1} and clock[0] >= 40
    assert any(s.get("paused") and s["pause_reason"] == "cpu>70%" for s in told) and not engine.state()["paused"]


def test_gate_is_the_state_machine():
    rng = random.Random(3)
    limits = LoadShedding(pause_after_s=4, resume_after_s=6)
    clock, high, paused, since, last = 0.0, None, False, 0.0, None
    current = Sample(0, 0, 8, 4)
    gate = Gate(limits, lambda: current, lambda: clock)
    for _ in range(500):
        clock += rng.choice([0.5, 1.0, 3.0])
        if rng.random() < 0.25 or last is None:
            last = rng.choice([Sample(90, 0, 8, 4), Sample(0, 0, 1, 4), Sample(0, 9, 8, 4), Sample(5, 0, 8, 4), Sample(5, None, 8, 4)])
        current = last
        now = high_reason(current, limits) is not None
        if now != high:
            high, since = now, clock
        if high and clock - since >= 4:
            paused = True
        elif not high and clock - since >= 6:
            paused = False
        assert gate.look() == paused
    broken = Gate(limits, lambda: 1 / 0, lambda: 0.0)
    assert not broken.look() and not broken.paused
    real = HostSampler()
    assert real().cores >= 1 and real().mem_available_gb > 0 and 0 <= real().cpu_percent <= 100


def test_embedder_chain(spark, tmp_path):
    with pytest.warns(UserWarning, match="left out"):
        assert models.first_that_works(["no.such.module:thing", "hash"], 16).dim == 16
    with pytest.warns(UserWarning), pytest.raises(RuntimeError):
        models.first_that_works(["nonsense"], 16)
    (tmp_path / "files").mkdir()
    (tmp_path / "files/a.txt").write_text("alpha")
    config = Config()
    config.models.text_embedders = ["hash"]
    engine = Engine(spark, f"file://{tmp_path}/index", config)
    engine.index([str(tmp_path / "files")])
    assert engine.search("alpha").count() == 1
