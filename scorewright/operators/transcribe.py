"""Running a transcriber over samples in batches, in Spark's Python workers."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWERS = "model string, dataset string, idx long, batch long, hypothesis string, error string, audio_s double, batch_infer_s double"


#: Sends a body, or asks for a page where there is none; the answer's status and content.
Send = Callable[[str, bytes | None], tuple[int, bytes]]
#: States of an answer after which a request is sent again: too many requests, and what passes in a server or before it.
RETRIED = (429, 500, 502, 503, 504)


class Transcriber(Protocol):
    """Answers for a batch of audio paths, as many and in their order."""

    def transcribe_batch(self, paths: Sequence[str]) -> list[str]: ...


class Echo:
    """A stand-in that answers with a function of the path."""

    def __init__(self, answer: Callable[[str], str]) -> None:
        self.answer = answer

    def transcribe_batch(self, paths: Sequence[str]) -> list[str]:
        return [self.answer(p) for p in paths]


class OneByOne:
    """Falls back to single paths where a batch fails; a path that fails alone gets an empty answer."""

    def __init__(self, inner: Transcriber) -> None:
        self.inner = inner

    def transcribe_batch(self, paths: Sequence[str]) -> list[str]:
        try:
            return self.inner.transcribe_batch(paths)
        except ImportError:
            raise
        except Exception:
            return [self._one(p) for p in paths]

    def _one(self, path: str) -> str:
        try:
            return self.inner.transcribe_batch([path])[0]
        except ImportError:
            raise
        except Exception:
            return ""


class Busy(OSError):
    """A server's answer that it can't take a request now."""


class Server:
    """A remote transcriber: posts recordings and hands on the texts of its answers in the recordings' order.

    At most ``window`` requests are under way at once. A server is first asked for its status until it
    runs. A request that fails, or that the server is too busy for, is sent again after a wait that grows
    each time; one that fails ``tries`` times, or is refused for another reason, and a recording that can't be
    read give an empty text, and the others of the batch theirs.
    """

    def __init__(self, url: str, language: str, model: str = "large-v3", batch_size: int = 1, vad: bool = True, sample_rate: int = 16_000, window: int = 4, tries: int = 4, wait: float = 1.0, send: Send | None = None, load: Callable[[str], bytes] | None = None) -> None:
        self.url, self.window, self.tries, self.wait = url.rstrip("/"), window, tries, wait
        self.body = {"model": model, "language": language, "batch_size": batch_size, "vad": vad, "sample_rate": sample_rate}
        self.send, self.load, self.is_ready = send or _send, load or _bytes, False

    def transcribe_batch(self, paths: Sequence[str]) -> list[str]:
        if not self.is_ready and not self.ready():
            return [""] * len(paths)
        with ThreadPoolExecutor(self.window) as pool:
            return [*pool.map(self._one, paths)]

    def _one(self, path: str) -> str:
        try:
            body = json.dumps({"file": base64.b64encode(self.load(path)).decode(), **self.body}).encode()
        except (OSError, ValueError):
            return ""
        for k in range(self.tries):
            if k:
                time.sleep(self.wait * 2 ** (k - 1))
            try:
                status, answer = self.send(f"{self.url}/transcribe", body)
                if status in RETRIED:
                    raise Busy(status)
                return server_text(json.loads(answer)) if status == 200 else ""
            except OSError:
                continue
            except ValueError:
                return ""
        return ""

    def status(self) -> str:
        """What the server says of itself, in capitals; empty where it says nothing that can be read."""
        try:
            status, answer = self.send(f"{self.url}/info", None)
            return str(json.loads(answer)["result"]["status"]).upper() if status == 200 else ""
        except (OSError, ValueError, KeyError, TypeError):
            return ""

    def ready(self, most: float = 300, wait: float = 5) -> bool:
        """Asks until the server runs, at most for so many seconds."""
        end = time.monotonic() + most
        while self.status() != "RUNNING":
            if time.monotonic() + wait > end:
                return False
            time.sleep(wait)
        self.is_ready = True
        return True


def server_text(answer: object) -> str:
    """The text of a server's parsed answer: a string, its text or transcript, or those of its results by their index."""
    if isinstance(answer, str):
        return answer.strip()
    if not isinstance(answer, dict):
        return ""
    if direct := answer.get("text") or answer.get("transcript"):
        return str(direct).strip()
    results = [x for x in answer.get("result") or [] if isinstance(x, dict)] if isinstance(answer.get("result"), list) else []
    if all(isinstance(x.get("result_index", 0), int | float) for x in results):
        results.sort(key=lambda x: x.get("result_index", 0))
    parts = (str(x.get("transcript_formatted") or x.get("transcript") or "").strip() for x in results)
    return " ".join(filter(None, parts))


def _bytes(path: str) -> bytes:
    """A recording's bytes, from any place that pyarrow opens."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    with system.open_input_stream(place) as file:
        return file.read()


def _send(url: str, body: bytes | None) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"} if body is not None else {})
    try:
        with urllib.request.urlopen(request, timeout=300) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as refusal:
        return refusal.code, refusal.read()


def coerced(answer: object) -> str:
    """The text of whatever a back end answers: a string, something with a text, the first of a tuple."""
    if isinstance(answer, tuple):
        answer = answer[0] if answer else ""
    return str(getattr(answer, "text", answer) or "").strip()


def transcribe(samples: DataFrame, model: str, make: Callable[[], Transcriber], batch_size: int = 16) -> DataFrame:
    """Answers for samples (dataset, idx, audio_path, duration), with the time that each batch took on its first row.

    A worker makes its transcriber once, before its first batch. Where a batch fails its answers are empty
    and say why; a batch with another number of answers than paths fails too. Write the result before using
    it twice: transcribing again is dear and takes another time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transcriber = None
        for frame in frames:
            for _, rows in frame.groupby(["dataset", "batch"], sort=True):
                rows = rows.sort_values("idx")
                transcriber = transcriber or make()
                began, error = time.perf_counter(), None
                try:
                    answers = [coerced(a) for a in transcriber.transcribe_batch(rows["audio_path"].tolist())]
                    if len(answers) != len(rows):
                        raise ValueError(f"{len(answers)} answers for {len(rows)} samples")
                except ImportError:
                    raise
                except Exception as failure:
                    answers, error = [""] * len(rows), f"{type(failure).__name__}: {failure}"
                took = time.perf_counter() - began
                yield pd.DataFrame({"model": model, "dataset": rows["dataset"], "idx": rows["idx"], "batch": rows["batch"], "hypothesis": answers, "error": error, "audio_s": rows["duration"], "batch_infer_s": [took, *[0.0] * (len(rows) - 1)]})

    batched = samples.select("dataset", "idx", "audio_path", "duration").withColumn("batch", F.floor(F.col("idx") / batch_size).cast("long"))
    return batched.repartition("dataset", "batch").sortWithinPartitions("dataset", "batch", "idx").mapInPandas(_whole_batches(run), ANSWERS)


def _whole_batches(run):
    """Hands on the rows of a batch together, wherever Arrow cuts the stream."""

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(held):
                continue
            last = (held["dataset"] == held["dataset"].iloc[-1]) & (held["batch"] == held["batch"].iloc[-1])
            if not last.all():
                yield held[~last]
                held = held[last]
        if held is not None and len(held):
            yield held

    return lambda frames: run(whole(frames))


def batch_times(answers: DataFrame) -> DataFrame:
    """(model, dataset, batch, audio_s, infer_s): what ``speed`` takes."""
    return answers.groupBy("model", "dataset", "batch").agg(F.sum("audio_s").alias("audio_s"), F.sum("batch_infer_s").alias("infer_s"))
