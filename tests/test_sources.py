import io
import json
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from scorewright.sources import corpus, manifest, matrix, runs
from scorewright.streaming.board_stream import follow

V2 = {"model": "m/a", "dataset": "d1", "language": "deu_Latn", "num_samples": 2, "num_skipped": 0, "schema_version": 2, "references": ["ort", "dialect"], "primary_reference": "ort", "timestamp": "2026-01-01T00:00:00",
      "results": {"ort": {"wer": 0.25, "cer": 0.1, "substitutions": 1, "deletions": 0, "insertions": 0, "num_samples": 2}}, "speed": {"rtfx": 20.0, "total_audio_s": 40.0, "total_infer_s": 2.0},
      "per_sample": [{"index": 0, "audio_path": "a.wav", "hypothesis": "x", "duration": 3.2, "references": {"ort": "x"}, "metrics": {"ort": {"wer": 0.0, "cer": 0.0}}, "inference_time": None, "speaker_id": "001", "raw_hypothesis": None, "extra": None}]}
V1 = {"model": "m/old", "dataset": "d1", "num_samples": 1, "results": {"dialect_reference": {"wer": 0.5, "cer": 0.2}, "ort_reference": {"wer": None}, "kan_reference": None},
      "per_sample": [{"index": 0, "hypothesis": "x", "dialect_reference": "y", "dialect_wer": 0.5, "dialect_cer": 0.2, "selected_speaker": 1, "all_speakers": {"1": {"text": "x"}}}]}


@pytest.fixture
def folder(tmp_path):
    own = tmp_path / "results"
    own.mkdir()
    for name, value in {"b.json": V2, "a.json": V1, "leaderboard.json": V2, ".hidden.json": V2, "no-model.json": {"results": {}}}.items():
        (own / name).write_text(json.dumps(value))
    (own / "broken.json").write_text("{broken")
    return own


def test_runs_of_both_versions(spark, folder):
    rows = {r["file"]: r for r in runs.read_runs(spark, str(folder)).collect()}
    assert sorted(rows) == ["a.json", "b.json"]
    old, new = rows["a.json"], rows["b.json"]
    assert (old["references"], old["primary_reference"], old["schema_version"], old["speed"]) == (["dialect"], "dialect", 1, {})
    assert json.loads(old["per_sample"][0]["extra"])["selected_speaker"] == "1" and old["per_sample"][0]["metrics"]["dialect"]["wer"] == 0.5
    assert new["results"]["ort"]["substitutions"] == 1 and new["speed"]["rtfx"] == 20.0 and new["per_sample"][0]["references"] == {"ort": "x"}


def test_migration(spark, folder, tmp_path):
    assert runs.migrate(spark, str(folder), str(tmp_path / "new"), dry_run=True)["migrated"] == 1
    counts = runs.migrate(spark, str(folder), str(tmp_path / "new"))
    assert (counts["migrated"], counts["skipped"]) == (1, 1) and counts["failed"] >= 1
    assert {r["schema_version"] for r in spark.read.parquet(str(tmp_path / "new")).collect()} == {2}


def test_results_written_one_by_one(spark, folder, tmp_path):
    read = runs.read_runs(spark, str(folder))
    assert runs.write_results(read, str(tmp_path / "out")) == sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".json" and p.name[0] != ".")
    (again,) = (json.loads(p.read_text()) for p in (tmp_path / "out").glob("*.json") if json.loads(p.read_text())["model"] == "m/a")
    assert list(again)[:3] == ["model", "dataset", "language"] and again["results"]["ort"]["wer"] == 0.25 and again["per_sample"][0]["inference_time"] is None
    facts = ["model", "dataset", "references", "primary_reference", "results", "per_sample"]
    key = lambda r: str([r[f] for f in facts])
    assert sorted(map(key, runs.read_runs(spark, str(tmp_path / "out")).collect())) == sorted(map(key, read.collect()))


def test_stream(spark, folder, tmp_path):
    places = [str(tmp_path / p) for p in ("runs", "board", "check")]
    (folder / "0.json").write_text(json.dumps(V2 | {"model": "first", "results": {"ort": {"wer": 0.2, "cer": 0.0}}}))
    follow(spark, str(folder), *places).awaitTermination()
    assert [r["model"] for r in spark.read.parquet(places[1]).orderBy("rank").collect()] == ["first", "m/a", "m/old"]
    (folder / "c.json").write_text(json.dumps(V2 | {"model": "better", "results": {"ort": {"wer": 0.01, "cer": 0.0}}}))
    follow(spark, str(folder), *places).awaitTermination()
    assert spark.read.parquet(places[1]).orderBy("rank").first()["model"] == "better"


def test_manifest(spark, tmp_path):
    lines = ['{"audio_filepath":"x/a.wav","text":"Guten Tag","duration":1.5,"utt_id":"u1"}', "", "{broken", '{"audio":"b.wav","text":"  Ja. "}', '{"audio_filepath":"c.wav","text":" "}', '{"text":"ohne Pfad"}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    rows = manifest.read_manifest(spark, str(tmp_path / "m.jsonl"), audio_root="/root").orderBy("idx").collect()
    assert [(r["idx"], r["audio_path"], r["transcript"], r["duration"]) for r in rows] == [(0, "/root/a.wav", "Guten Tag", 1.5), (1, "/root/b.wav", "Ja.", 0.0)]
    assert [r["transcript"] for r in manifest.read_manifest(spark, str(tmp_path / "m.jsonl"), offset=1, limit=1).collect()] == ["Ja."]


def test_a_missing_duration_comes_from_the_header(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(2.5))
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"audio": f"/elsewhere/{n}.wav", "text": "x"} | more) for n, more in (("a", {}), ("b", {}), ("a", {"duration": 9.0}))))
    rows = manifest.read_manifest(spark, str(tmp_path / "m.jsonl"), audio_root=str(tmp_path)).orderBy("idx").collect()
    assert [r["duration"] for r in rows] == [2.5, 0.0, 9.0]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    for name, n in (("a.txt", 900), ("b.txt", 40)):
        (tmp_path / name).write_bytes(b"".join(b"%d\r\n" % k if k % 7 else b"\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        rows = manifest.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, n in (("a.txt", 900), ("b.txt", 40)):
        own = sorted((r["line"], r["value"]) for r in rows if r["file"].endswith(name))
        assert own == [(k, str(k) if k % 7 else "") for k in range(n)]


@pytest.mark.parametrize("cut", [False, True])
def test_a_dense_index_over_pieces(spark, cut):
    pieces = (F.floor(F.col("k") / 10),) if cut else ()
    rows = [(d, k, k % 3) for d in ("x", "y", None) for k in range(0, 95, 2 if d else 5)]
    got = manifest.indexed(spark.createDataFrame(rows, "dataset string, k long, within int").repartition(7), "k", pieces=pieces).collect()
    want = {(d, k): n for d in ("x", "y", None) for n, k in enumerate(sorted(k for e, k, _ in rows if e == d))}
    assert {(r["dataset"], r["k"]): r["idx"] for r in got} == want and len(got) == len(rows) and {r["within"] for r in got} == {0, 1, 2}
    assert manifest.indexed(spark.createDataFrame([], "dataset string, k long"), "k", pieces=pieces).count() == 0


def test_hypotheses(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"ref":"a","text":"b","hyp":"c"}\n{"text":"b","index":7}\n')
    rows = manifest.read_hypotheses(spark, str(tmp_path / "h.jsonl"), "m", "d").orderBy("idx").collect()
    assert [(r["idx"], r["reference"], r["hypothesis"]) for r in rows] == [(0, "a", "c"), (7, "b", "")]
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):  # noqa: B017
        manifest.read_hypotheses(spark, str(tmp_path / "bad.jsonl"), "m", "d").collect()


def wav(seconds):
    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setnchannels(1)
        sound.setsampwidth(2)
        sound.setframerate(8000)
        sound.writeframes(b"\0\0" * int(8000 * seconds))
    return out.getvalue()


def test_corpus(spark, tmp_path):
    root = tmp_path / "corpus"
    for speaker, name, body in (("001", "sp1c1.wav", wav(1.5)), ("001", "sp1c9.nis", b"nis"), ("002", "sp1c2.nis", b"nis"), ("abc", "sp1c3.wav", b""), ("003", "sp1c4.wav", b"broken")):
        (root / speaker).mkdir(parents=True, exist_ok=True)
        (root / speaker / name).write_bytes(body)
    (root / "001" / "sp1c1.par").write_bytes('ORT:\t0\tsch"on\nORT:\t1\t.\nTR2:\t0\tsch"o<!1 scho>\nKAN:\t0\tS2:n\nXXX:\t0\tq\nORT:\t2\n'.encode() + b"\xff\n")
    (root / "002" / "sp1c2.par").write_text("TR2:\t0\tja\n")
    (root / "003" / "sp1c4.par").write_text("KAN:\t0\tja\n")
    table = tmp_path / "sprk_att.txt"
    table.write_bytes('filenr\tage\tborn\tsex\n1\t30\tM"unchen\t-\n1\t31\tK\xf6ln\n1000\t9\tx\tm\n'.encode("latin-1"))
    rows = {r["speaker_id"]: r for r in corpus.read_corpus(spark, str(root), table=str(table)).collect()}
    assert sorted(rows) == ["001", "002"]
    one, two = rows["001"], rows["002"]
    assert one["references"] == {"dialect": "scho", "ort": "schön.", "kan": "S2:n"} and one["primary_reference"] == "ort" and one["duration"] == 1.5
    assert one["metadata"] == {"stem": "sp1c1", "speaker_speaker_number": "1", "speaker_age": "31", "speaker_birth_location": "Köln"}
    assert two["primary_reference"] == "dialect" and two["duration"] == 0.0 and two["metadata"] == {"stem": "sp1c2"}


@pytest.mark.parametrize("place", ["table/sprk_att.txt", "RVG1Docu/table/sprk_att.txt", "CLARINDocu.zip", "elsewhere/sprk_att.txt", "broken.zip"])
def test_a_corpus_has_its_own_speaker_table(spark, tmp_path, place):
    root, table = tmp_path / "corpus", b"filenr\tage\n7\t30\n"
    if place.endswith(".zip"):
        root.mkdir()
        with zipfile.ZipFile(root / "CLARINDocu.zip", "w") as archive:
            archive.writestr("RVG1Docu/table/sprk_att.txt", table)
        if place == "broken.zip":
            (root / "CLARINDocu.zip").write_bytes(b"broken")
    else:
        (root / place).parent.mkdir(parents=True)
        (root / place).write_bytes(table)
    got = [(r["speaker"], r["attributes"]) for r in corpus.speakers(corpus.found_table(spark, str(root))).collect()]
    assert got == ([] if place in ("elsewhere/sprk_att.txt", "broken.zip") else [("007", {"speaker_number": "7", "age": "30"})])


def test_languages_and_groups_of_jobs(spark):
    asked = [("whisper", "fra_Latn", "french"), ("whisper", "xxx", "german"), ("granite", "ita_Latn", "English"), ("voxtral", "hin_Deva", "hi"), ("cohere", "xxx", "de"), ("canary-1b", "swe_Latn", "sv"), ("canary-1b", "Xyz_Latn", "xy"), ("http", "deu_Latn", "de"), ("qwen3-asr", "ind_Latn", "Indonesian"), ("qwen3-asr", "eus_Latn", None), ("crisperwhisper", "eus_Latn", "basque")]
    got = spark.createDataFrame(asked, "backend string, code string, want string").select("want", matrix.language(F.col("backend"), F.col("code")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    jobs = matrix.read_matrix(spark, "datasets: [{name: d1}, {name: d2}]\nmodels: [{name: o/a}, {name: o/b}]")
    assert {r["job_group"]: [j["dataset"] for j in r["jobs"]] for r in matrix.job_groups(jobs, by_model=True).collect()} == {matrix_tag: ["d1", "d2"] for matrix_tag in ("o_a", "o_b")}
    assert matrix.job_groups(jobs).count() == 4


def test_transliterations(spark, tmp_path):
    (tmp_path / "a.trl").write_text("; note\n\nx: ich +/wir/+ gehe .\nja\n")
    assert corpus.transliterations(spark, str(tmp_path / "a.trl")).first()["text"] == "ich wir gehe. ja"


def test_matrix(spark, monkeypatch):
    monkeypatch.setenv("DATA", "/data")
    text = "defaults: {language: deu_Latn, batch_size: 8}\ndatasets: [{name: d1, data_dir: '${DATA}/x', params: {channel: c}}, {name: d2}]\nmodels: [{name: openai/whisper, batch_size: 0}, {name: gemma, batch_size: 2, language: eng_Latn}]"
    rows = matrix.read_matrix(spark, text).orderBy("model_ordinal", "dataset_ordinal").collect()
    assert [(r["model"], r["dataset"], r["batch_size"], r["language"], r["data_dir"], r["backend"]) for r in rows] == [("openai/whisper", "d1", 8, "deu_Latn", "/data/x", "whisper"), ("openai/whisper", "d2", 8, "deu_Latn", None, "whisper"), ("gemma", "d1", 2, "eng_Latn", "/data/x", "gemma"), ("gemma", "d2", 2, "eng_Latn", None, "gemma")]
    with pytest.raises(ValueError):
        matrix.read_matrix(spark, "models: []")
    assert matrix.read_environment('# c\nA="b c"\nnothing\n') == {"A": "b c"}
    assert matrix.canonical_dataset("BAS-RVG1", {"bas_rvg1": "rvg1"}) == "rvg1"
    with pytest.raises(KeyError):
        matrix.canonical_dataset("x", {"a": "b"})
