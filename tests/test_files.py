"""Result files of any size, migration that is stopped anywhere, the server's client, the page with its files, the board with state."""

import io
import json
import random
import threading
import tracemalloc
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from scorewright.operators import board, candidates, transcribe
from scorewright.sources import manifest, matrix, migration, render, result_stream, runs
from scorewright.streaming import board_state

from .test_sources import V1, V2, folder  # noqa: F401


# result files of any size


class Endless(io.RawIOBase):
    """A result file that is made as it is read."""

    def __init__(self, samples):
        self.parts = self._parts(samples)
        self.rest, self.given = b"", 0

    def _parts(self, samples):
        yield b'{"model": "m", "per_sample": ['
        text = "wörd " * 40
        for k in range(samples):
            yield (("," if k else "") + json.dumps({"index": k, "hypothesis": text, "metrics": {"ort": {"wer": k / 7}}, "nested": [[{"a": "}]"}]]})).encode()
        yield b'], "dataset": "d", "num_samples": %d, "results": {"ort": {"wer": 0.5}}}' % samples

    def read(self, n=-1):
        while len(self.rest) < n:
            part = next(self.parts, None)
            if part is None:
                break
            self.rest += part
        out, self.rest = self.rest[:n], self.rest[n:]
        self.given += len(out)
        return out


def test_a_large_file_is_read_in_little_memory(spark):
    schema = result_stream.StructType.fromDDL("file string, index bigint, hypothesis string")
    file = Endless(120_000)
    tracemalloc.start()
    n = total = 0
    for row in result_stream.sample_rows(file, "f.json", schema, size=1 << 16):
        n, total = n + 1, total + row[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 120_000 and total == n * (n - 1) // 2 and file.given > 40_000_000 and peak < 4_000_000
    run = [*result_stream.run_rows(Endless(500), "f.json", result_stream.StructType.fromDDL("dataset string, samples bigint, file string"), size=64)]
    assert run == [("d", 500, "f.json")]


def random_json(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -1, 12345678901, 1.5, -2e-7, 1e300])
    if kind < 5:
        return "".join(rng.choices('ab"\\/{}[],:\nä\U0001f600', k=rng.randrange(9)))
    if kind < 7:
        return {f"k{n}" + rng.choice(["", '"', "ä"]): random_json(rng, depth + 1) for n in range(rng.randrange(4))}
    return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_pieces_are_the_values(size):
    rng = random.Random(size)
    for _ in range(300):
        value = {f"f{n}": random_json(rng) for n in range(rng.randrange(4))} | {"list": [random_json(rng) for _ in range(rng.randrange(5))]}
        raw = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        pieces, got = result_stream.Pieces(io.BytesIO(raw), size), {}
        for name in pieces.fields():
            got[name] = [*pieces.elements()] if name == "list" else pieces.value()
        assert got == value


@pytest.mark.parametrize("raw", [b"", b"{", b'{"per_sample": [{"index": 1}', b'{"per_sample": [{"index": 1} {"index": 2}]}', b"[1]", b'{"a" 1}', b'{"a": }', b'{1: 2}', b'{"a": "\xff"}', b'{"per_sample": [{"index": 1}, ' + b"[" * 5000])
def test_broken_files_are_no_runs(spark, raw):
    schema = result_stream.StructType.fromDDL("index bigint")
    assert [*result_stream.run_rows(io.BytesIO(raw), "f", schema, 4)] == []
    assert [*result_stream.sample_rows(io.BytesIO(raw), "f", schema, 4)] in ([], [(1,)])


def test_an_early_error_ends_the_reading():
    raw = io.BytesIO(b'{"a": nothing, ' + b" " * 10_000_000)
    with pytest.raises(ValueError):
        [result_stream.Pieces(raw, 100).value()]
    assert raw.tell() < 1000


def test_the_source_gives_what_the_whole_files_give(spark, folder):  # noqa: F811
    whole = runs.read_runs(spark, str(folder))
    facts = ["file", "model", "dataset", "language", "num_samples", "schema_version", "references", "primary_reference", "results", "speed"]
    got = result_stream.runs_of_any_size(spark, str(folder))
    assert sorted(str(r) for r in got.select(*facts).collect()) == sorted(str(r) for r in whole.select(*facts).collect())
    assert {r["file"]: r["samples"] for r in got.collect()} == {r["file"]: len(r["per_sample"]) for r in whole.collect()}
    each = result_stream.samples_of_any_size(spark, str(folder)).orderBy("file", "ordinal").select("file", "sample").collect()
    want = whole.select("file", F.explode("per_sample").alias("sample")).orderBy("file", "sample.index").collect()
    plain = [(r["file"], r["sample"]["index"], r["sample"]["hypothesis"], r["sample"]["references"], r["sample"]["metrics"], r["sample"]["duration"]) for r in each]
    assert plain == [(r["file"], r["sample"]["index"], r["sample"]["hypothesis"], r["sample"]["references"], r["sample"]["metrics"], r["sample"]["duration"]) for r in want]
    assert json.loads(each[0]["sample"]["extra"])["selected_speaker"] == "1"
    few = result_stream.sample_columns(spark, str(folder), "hypothesis")
    assert few.columns == ["file", "hypothesis"] and few.count() == 2
    (folder.parent / "none").mkdir()
    assert result_stream.runs_of_any_size(spark, str(folder.parent / "none")).count() == 0


# migration


def staged(root, backup=True):
    root.mkdir()
    for name in ("a.json", "b.json", "c.json"):
        (root / name).write_text("old " + name)
    (root / "v1_backup").mkdir()
    (root / "v1_backup" / "b.json").write_text("older b.json")
    place = migration.Folder(str(root))
    place.make(".migration/new")
    for name in ("a.json", "b.json"):
        place.write(f".migration/new/{name}", b"new " + name.encode())
    place.write(".migration/journal.json", json.dumps({"backup": backup, "files": {n: migration._free(place, n) if backup else "" for n in ("a.json", "b.json")}}).encode())
    return place


def contents(root):
    return sorted(p.read_text() for p in root.rglob("*.json*"))


class Stopped(Exception):
    pass


@pytest.mark.parametrize("backup", [True, False])
@pytest.mark.parametrize("onward", ["again", "back"])
def test_migration_stopped_at_each_move(tmp_path, monkeypatch, backup, onward):
    move = migration.Folder.move
    for stop in range(8):
        root = tmp_path / f"{backup}{onward}{stop}"
        place, left = staged(root, backup), [stop]

        def limited(self, name, to, left=left):
            if not left[0]:
                raise Stopped
            left[0] -= 1
            move(self, name, to)

        monkeypatch.setattr(migration.Folder, "move", limited)
        try:
            assert migration.go_forward(place) == 2
        except Stopped:
            texts = contents(root)
            assert all(any(t.endswith(f"{kind} {n}.json") for t in texts) for n in "ab" for kind in (("old",) if backup else ("new",)))
        monkeypatch.setattr(migration.Folder, "move", move)
        if onward == "back" and (root / ".migration" / "journal.json").exists():
            if not backup:
                with pytest.raises(ValueError):
                    migration.roll_back(str(root))
                continue
            migration.roll_back(str(root))
            assert [(root / f"{n}.json").read_text() for n in "abc"] == [f"old {n}.json" for n in "abc"]
        else:
            migration.go_forward(place)
            assert [(root / f"{n}.json").read_text() for n in "abc"] == ["new a.json", "new b.json", "old c.json"]
            if backup:
                assert sorted(p.name for p in (root / "v1_backup").iterdir()) == ["a.json", "b.json", "b.json.1"]
        assert (root / "v1_backup" / "b.json").read_text() == "older b.json" and not (root / ".migration").exists()


def test_migration_in_place(spark, folder):  # noqa: F811
    before = {r["file"]: r for r in runs.read_runs(spark, str(folder)).collect()}
    assert migration.migrate_in_place(spark, str(folder), dry_run=True) == {"migrated": 1, "skipped": 1, "failed": 0, "resumed": 0}
    (folder / ".migration").mkdir()
    (folder / ".migration" / "half").write_text("left by a run that was stopped early")
    assert migration.migrate_in_place(spark, str(folder)) == {"migrated": 1, "skipped": 1, "failed": 0, "resumed": 0}
    after = {r["file"]: r for r in runs.read_runs(spark, str(folder)).collect()}
    assert {k: v["schema_version"] for k, v in after.items()} == {"a.json": 2, "b.json": 2}
    assert after["a.json"]["results"] == before["a.json"]["results"] and after["a.json"]["per_sample"] == before["a.json"]["per_sample"]
    assert json.loads((folder / "v1_backup" / "a.json").read_text()) == V1 and (folder / "broken.json").read_text() == "{broken"
    assert not (folder / ".migration").exists() and migration.migrate_in_place(spark, str(folder))["migrated"] == 0


def test_differing_runs_are_told(spark, folder):  # noqa: F811
    own = runs.read_runs(spark, str(folder))
    assert migration.differing(own, own).count() == 0
    worse = own.withColumn("results", F.transform_values("results", lambda _, m: m.withField("wer", m["wer"] + 1e-6)))
    assert migration.differing(own, worse).count() == 2
    assert [r["file"] for r in migration.differing(own, own.where("file = 'a.json'")).collect()] == ["b.json"]
    assert migration.differing(own, own.withColumn("num_samples", F.lit(9).cast("long"))).count() == 2


# the server's client


@pytest.fixture
def server():
    state = {"info": ["BUSY", "RUNNING"], "fail": {}, "seen": [], "now": 0, "most": 0, "lock": threading.Lock()}

    class Answers(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _say(self, status, body):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            said = state["info"].pop(0) if len(state["info"]) > 1 else state["info"][0]
            self._say(200, json.dumps({"result": {"status": said}}).encode() if said else b"?")

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with state["lock"]:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                state["seen"].append(body)
                left = state["fail"].get(body["file"], [])
                status = left.pop(0) if left else 200
            threading.Event().wait(0.02)
            with state["lock"]:
                state["now"] -= 1
            text = json.dumps({"result": [{"result_index": 1, "transcript": "end"}, {"result_index": 0, "transcript_formatted": body["file"]}]})
            self._say(status, text.encode() if status != 299 else b"no json")

    own = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", state
    own.shutdown()


def test_server_answers_in_order_within_a_window(server, tmp_path):
    url, state = server
    paths = []
    for k in range(12):
        (tmp_path / f"{k}.wav").write_bytes(bytes([k, k, k]))
        paths.append(str(tmp_path / f"{k}.wav"))
    paths.insert(4, str(tmp_path / "missing.wav"))
    code = [transcribe.base64.b64encode(bytes([k, k, k])).decode() for k in range(12)]
    state["fail"] = {code[2]: [503, 429], code[5]: [400], code[7]: [500] * 9, code[9]: [299]}
    client = transcribe.Server(url, "de", window=3, wait=0.01)
    assert client.ready(most=5, wait=0.01)
    got = client.transcribe_batch(paths)
    want = [f"{c} end" for c in code]
    want[5] = want[7] = want[9] = ""
    want.insert(4, "")
    assert got == want and 1 < state["most"] <= 3
    assert len([x for x in state["seen"] if x["file"] == code[2]]) == 3 and len([x for x in state["seen"] if x["file"] == code[5]]) == 1
    assert {k: v for k, v in state["seen"][0].items() if k != "file"} == {"model": "large-v3", "language": "de", "batch_size": 1, "vad": True, "sample_rate": 16_000}


def test_server_that_never_runs(server):
    url, state = server
    for said in ("BUSY", ""):
        state["info"] = [said]
        assert not transcribe.Server(url, "de").ready(most=0.05, wait=0.01)
    state["info"] = ["running"]
    assert transcribe.Server(url, "de").ready(most=0.05, wait=0.01)
    assert not transcribe.Server("http://127.0.0.1:9", "de").ready(most=0.05, wait=0.01)


def test_server_texts():
    for answer, text in (("  a ", "a"), ({"text": "", "transcript": " b"}, "b"), ({"result": "x"}, ""), ({}, ""), (None, ""), ({"result": [{"transcript": "b", "result_index": "x"}, 7, {"transcript": " a "}]}, "b a")):
        assert transcribe.server_text(answer) == text


# wrong readers and renderers


def test_hypotheses_after_blank_lines(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('\n{"ref":" a ","hyp":" x "}\n\n  \n{"text":"b\\t","index":null,"hyp":"y"}\n{"ref":"","text":"c","index":9}\n{"ref":"d"}\n')
    rows = manifest.read_hypotheses(spark, str(tmp_path / "h.jsonl"), "m", "d").collect()
    assert sorted((r["idx"], r["reference"], r["hypothesis"]) for r in rows) == [(0, "a", "x"), (1, "b", "y"), (3, "d", ""), (9, "c", "")]


def test_languages_of_a_server(spark):
    asked = [("deu_Latn", "de"), ("eng_Latn", "en"), ("fra_Latn", "fr"), ("spa_Latn", "es"), ("ita_Latn", "it"), ("NLD_Latn", "nld"), ("x", "x")]
    got = spark.createDataFrame(asked, "code string, want string").select("want", matrix.language(F.lit("http"), F.col("code")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_plain_answers(spark):
    cases = [
        ("[12] apples in [1] box", "[12] apples in [1] box"),
        ("[00:00.00 - 00:05.00] Speaker 1: Hello\n\nspeaker_2: [00:01.00-00:02.50] you", "Hello you"),
        ('{"Speaker":0,"Content":"a {b} [c]"} and {"Speaker":1,"Content":"d \\"e\\""}', 'a {b} [c] d "e"'),
        ('[{"Speaker":1,"Content":"cut { off', "cut { off"),
        ("", ""),
    ]
    got = spark.createDataFrame([(a,) for a, _ in cases], "raw string").select(candidates.plain_text(F.col("raw")).alias("t")).collect()
    assert [r["t"] for r in got] == [b for _, b in cases]


def test_speaker_choice_keeps_all_speakers(spark):
    raw = json.dumps([{"Speaker": 1, "Content": "hello world"}, {"Speaker": 0, "Content": "good bye now"}, {"Speaker": 1, "Content": "again"}])
    answers = spark.createDataFrame([("m", "d", 1, raw), ("m", "d", 2, "plain"), ("m", "d", 3, None), ("m", "d", 9, "to nothing")], "model string, dataset string, idx long, raw string")
    samples = spark.createDataFrame([("d", 1, {"ort": "hello world again", "dialect": "good by now"}), ("d", 2, {"ort": "", "dialect": None}), ("d", 3, {"ort": "x"})], "dataset string, idx long, references map<string,string>")
    out = candidates.speaker_choice(answers, samples)
    rows = {r["idx"]: r.asDict(recursive=True) for r in out.withColumn("extra", candidates.override_extra(F.col("selected_speaker"), F.col("all_speakers"))).collect()}
    assert sorted(rows) == [1, 2, 3] and (rows[1]["selected_speaker"], rows[1]["hypothesis"]) == (1, "hello world again")
    assert rows[1]["all_speakers"]["0"]["rates"]["dialect"]["wer"] == pytest.approx(1 / 3) and rows[1]["all_speakers"]["1"]["rates"]["ort"]["wer"] == 0
    assert (rows[2]["hypothesis"], rows[2]["selected_speaker"], rows[2]["all_speakers"]["0"]) == ("", 0, {"text": "plain", "rates": {}})
    assert (rows[3]["hypothesis"], rows[3]["all_speakers"]["0"]["rates"]["ort"]["wer"]) == ("", 1.0)
    extra = json.loads(rows[1]["extra"])
    assert extra["selected_speaker"] == 1 and extra["all_speakers"]["0"]["dialect_wer"] == pytest.approx(1 / 3) and extra["all_speakers"]["1"]["text"] == "hello world again"


# the page


def some_runs(spark, rates):
    own = []
    for k, (model, wer) in enumerate(rates.items()):
        samples = [(n, "s", 1.25, {"ort": f"ref {n}"}, f"{model} {n} </script>", {"ort": (wer, None)}) for n in range(5)]
        own.append((f"{k}.json", model, "d/1", "deu", 5, "ort", {"ort": (wer, wer / 2 if wer is not None else None, 5)}, {"rtfx": 2.0}, samples))
    schema = "file string, model string, dataset string, language string, num_samples long, primary_reference string, results map<string,struct<wer:double,cer:double,num_samples:long>>, speed map<string,double>, per_sample array<struct<index:long,speaker_id:string,duration:double,references:map<string,string>,hypothesis:string,metrics:map<string,struct<wer:double,cer:double>>>>"
    return spark.createDataFrame(own, schema)


def test_the_best_is_so_by_its_value(spark):
    shown = render.Board(some_runs(spark, {"a": 0.1234, "b": 0.1231, "c": 0.1231 + 1e-12, "d": None}))
    lines = {line.split(" | ")[1]: line for line in render.markdown(shown).splitlines()[2:]}
    assert "**" not in lines["a"] and lines["b"].count("**12.3%**") == 2 and lines["c"].count("**12.3%**") == 2 and "**" not in lines["d"]
    assert [m for _, m, _ in shown.bars(("d/1", "ort"))] == ["b", "c", "a", "d"] and shown.bars(render.AVERAGE)[0][0] == "1. b"
    assert set(shown.bounds) == {(c, k) for c in (("d/1", "ort"), render.AVERAGE) for k in render.KINDS}
    assert shown.bounds[("d/1", "ort"), "cer"][0] == pytest.approx(0.1231 / 2)


def test_the_page_and_its_files(spark, tmp_path):
    own = some_runs(spark, {"a": 0.1, "b <x>": 0.2})
    index = render.write_page(own, str(tmp_path / "page"), size=2)
    assert [(x["dataset"], x["first"], x["last"], x["n"]) for x in index] == [("d/1", 0, 1, 2), ("d/1", 2, 3, 2), ("d/1", 4, 4, 1)]
    held = {}
    for x in index:
        held |= json.loads((tmp_path / "page" / x["file"]).read_text())
    assert sorted(held) == ["0", "1", "2", "3", "4"] and held["3"]["truth"] == {"spk": "s", "dur": 1.2, "refs": {"ort": "ref 3"}}
    assert held["3"]["said"] == {"a": {"hyp": "a 3 </script>", "m": {"ort": [0.1, None]}}, "b <x>": {"hyp": "b <x> 3 </script>", "m": {"ort": [0.2, None]}}}
    page = (tmp_path / "page" / "index.html").read_text()
    assert page.count("class='bar'") == 8 and all(x["file"] in page for x in index) and "b &lt;x&gt;" in page and "a 3" not in page
    assert page.count("data-sort='0.050000'") == 2 and page.count("</script>") == 1


# the board with state


def test_the_board_with_state(spark, folder, tmp_path):  # noqa: F811
    places = [str(tmp_path / p) for p in ("facts", "board", "check")]

    def step():
        board_state.follow_with_state(spark, str(folder), *places).awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(places[1]).orderBy("rank").collect()]
        assert got == [tuple(r) for r in board.leaderboard(runs.read_runs(spark, str(folder))).orderBy("rank").collect()]
        return [r[1] for r in got]

    (folder / "0.json").write_text(json.dumps(V2 | {"model": "first", "results": {"ort": {"wer": 0.2, "cer": 0.0}}}))
    assert step() == ["first", "m/a", "m/old"]
    (folder / "c.json").write_text(json.dumps(V2 | {"model": "better", "results": {"ort": {"wer": 0.01, "cer": 0.0}}}))
    assert step() == ["better", "first", "m/a", "m/old"]
    (folder / "d.json").write_text(json.dumps(V2 | {"model": "better", "results": {"ort": {"wer": 0.9, "cer": 0.0}}}))
    (folder / "e.json").write_text(json.dumps(V2 | {"dataset": "d2", "primary_reference": "dialect", "results": {"dialect": {"wer": 0.7, "cer": 0.1}}}))
    assert step() == ["first", "m/a", "better", "m/old"]
    last = sorted((tmp_path / "facts").iterdir(), key=lambda p: int(p.name))[-1]
    kept = spark.read.parquet(str(last))
    assert kept.count() == 6 and "per_sample" not in kept.first()["fact"]


# smaller items


def test_datasets_and_transcribers_by_name(spark, tmp_path, monkeypatch):
    from scorewright.sources import registry

    (tmp_path / "m.jsonl").write_text('{"audio":"b.wav","text":"Ja.","duration":1.0}')
    preset = registry.open_dataset(spark, "KSOF", path=str(tmp_path / "m.jsonl")).first()
    assert (preset["dataset"], preset["primary_reference"], preset["transcript"]) == ("ksof", "ref", "Ja.")
    registry.add_dataset("My-Own", lambda session, n: session.range(n))
    assert registry.open_dataset(spark, "my_OWN", n=3).count() == 3
    with pytest.raises(KeyError, match="manifest"):
        registry.open_dataset(spark, "nothing")
    names = ["openai/whisper", "nyra/CrisperWhisper", "https://x", "unheard of", "stt_de_conformer", "granite-nar"]
    routes = spark.createDataFrame([(n,) for n in names], "n string").select(matrix.route(F.col("n")).alias("r")).collect()
    assert [registry.backend_of(n) for n in names] == [r["r"] for r in routes]
    assert isinstance(registry.maker("http://h", "de")(), transcribe.Server)
    with pytest.raises(KeyError):
        registry.maker("openai/whisper", "de")
    registry.add_transcriber("whisper", lambda model, language, size: transcribe.Echo(lambda p: f"{model} {language} {size} {p}"))
    assert registry.maker("openai/whisper", "de", 2)().transcribe_batch(["p"]) == ["openai/whisper de 2 p"]
    monkeypatch.delitem(registry.TRANSCRIBERS, "whisper")
    monkeypatch.delitem(registry.DATASETS, "my_own")


def test_a_corpus_is_where_the_environment_says(spark, tmp_path, monkeypatch):
    from scorewright.sources import corpus

    from .test_sources import wav

    (tmp_path / "001").mkdir()
    (tmp_path / "001" / "sp1c1.wav").write_bytes(wav(1.5))
    (tmp_path / "001" / "sp1c1.par").write_text("ORT:\t0\tja\n")
    monkeypatch.setenv(corpus.ROOT_VARIABLE, str(tmp_path))
    (row,) = corpus.read_corpus(spark).collect()
    assert (row["transcript"], row["duration"]) == ("ja", 1.5)


def test_chart_runs_need_no_model_and_no_mercy(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": {"ort": {"wer": 0.5}}, "schema_version": 2}))
    assert runs.read_chart_runs(spark, str(tmp_path)).first()["model"] == "" and runs.read_runs(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.json").write_text("{broken")
    with pytest.raises(Exception):  # noqa: B017
        runs.read_chart_runs(spark, str(tmp_path)).collect()


def test_terminal_styles_and_labels(spark):
    shown = render.Board(some_runs(spark, {"a": 0.1, "b": 0.4, "c": None}))
    plain, styled = render.text(shown), render.text(shown, styled=True)
    assert "\x1b" not in plain and styled.count(render.BOLD) == 4 and styled.count(render.DIM) == 4
    import re

    assert re.sub("\x1b[^m]*m", "", styled) == plain
    assert render.labelled(["ref", "kan", "ort", "x", "ref"]) == [("ort", "ORT"), ("kan", "KAN"), ("ref", "ref"), ("x", "x")]
    assert '"labels": [["ort", "ORT"]]' in render.page(shown)


def test_missing_values_are_last_upwards_and_first_downwards(spark):
    rows = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0), (4, None)], "rank int, v double")
    assert [r["rank"] for r in rows.orderBy(*board.table_order("v")).collect()] == [3, 2, 1, 4]
    assert [r["rank"] for r in rows.orderBy(*board.table_order("v", descending=True)).collect()] == [1, 4, 2, 3]
