"""Model calls as batch functions over partitions: captions, answers, transcripts, embeddings. The models are the caller's.

A model is given by a loader that each worker calls once. Every input row gives exactly one output row, whatever fails."""

from __future__ import annotations

import base64
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.image import png, shrink
from ..functions.text import NO_CAPTION
from ..session import stored

#: Models this worker has loaded, by name, the last used ones; a model's name must tell it from every other, its revision included.
_LOADED: dict[str, Any] = {}
LOADED_MOST = 2


class OutOfMemory(RuntimeError):
    """Raised by a model for which a batch was too large."""


class ModelLost(RuntimeError):
    """Raised by a model that can do nothing more in this process; what is left to do is marked as lost and not tried."""


LOST = "lost: "


def _model(name: str, load: Callable[[], Any]) -> Any:
    if name in _LOADED:
        _LOADED[name] = _LOADED.pop(name)  # the last used comes last
    else:
        while len(_LOADED) >= LOADED_MOST:
            _LOADED.pop(next(iter(_LOADED)))
        _LOADED[name] = load()
    return _LOADED[name]


def _named(model: str | None) -> str:
    """A model without a name is shared with no other call: two loaders can look alike and load different models."""
    return model or uuid.uuid4().hex


def in_batches(call: Callable[[list], list], inputs: list, size: int, placeholder: Any) -> tuple[list, list[str | None]]:
    """Outputs and errors, one for each input. A batch that is too large is halved and tried again; what fails by itself, or for any other
    reason, becomes the placeholder. Outputs of a batch that failed are never kept beside their replacement. After ModelLost no further call is made."""
    out: list = [placeholder] * len(inputs)
    errors: list[str | None] = [None] * len(inputs)
    todo = [(k, min(k + size, len(inputs))) for k in range(0, len(inputs), size)][::-1]
    lost = ""
    while todo:
        start, end = todo.pop()
        if lost:
            errors[start:end] = [lost] * (end - start)
            continue
        try:
            got = list(call(inputs[start:end]))
            if len(got) != end - start:
                raise ValueError(f"{end - start} inputs gave {len(got)} outputs")
            out[start:end] = got
        except OutOfMemory as e:
            if end - start == 1:
                errors[start] = str(e) or "out of memory"
            else:
                middle = (start + end) // 2
                todo += [(middle, end), (start, middle)]
        except ModelLost as e:
            lost = f"{LOST}{e}"
            errors[start:end] = [lost] * (end - start)
        except Exception as e:
            errors[start:end] = [f"{type(e).__name__}: {e}"] * (end - start)
    return out, errors


def captioned(rows: DataFrame, column: str, load: Callable[[], Callable[[list], list]], output: str = "caption", batch: int = 4, placeholder: str = NO_CAPTION, model: str | None = None) -> DataFrame:
    """rows with the model's text for `column`, an error column, and seconds taken. Narrow: no shuffle, rows stay where they are.

    model names what load() gives, name and revision; calls that name the same model share it within a worker. seconds is a row's share of the time of
    its batch. A model that is lost ends its worker's calls, and the rows that were left have an error that begins with LOST."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{output}` string, error string, seconds double"
    name = _named(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, lost = _model(name, load), ""
        for pdf in parts:
            out, errors, seconds = [], [], []
            inputs = pdf[column].tolist()
            for k in range(0, len(inputs), batch):
                some = inputs[k : k + batch]
                began = time.perf_counter()
                got, wrong = ([placeholder] * len(some), [lost] * len(some)) if lost else in_batches(call, some, batch, placeholder)
                lost = lost or next((e for e in wrong if e and e.startswith(LOST)), "")
                out += got
                errors += wrong
                seconds += [(time.perf_counter() - began) / len(some)] * len(some)
            yield pdf.assign(**{output: out, "error": errors, "seconds": seconds})
        if lost:
            _LOADED.pop(name, None)

    return rows.mapInPandas(run, schema)


def succeeded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the list of those that were skipped."""
    return rows.filter("error is null").drop("error"), rows.filter("error is not null")


def cached_captions(work: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all, new): what the cache has of work, and what compute() makes of the rest; new rows are to be appended to the cache.

    What was made is stored, so that both tables have the same rows and no model is asked twice."""
    new = stored(compute(work.join(cache.select(*keys), keys, "left_anti")).select(*cache.columns), "made")
    hits = cache.join(work.select(*keys), keys, "left_semi")
    return hits.unionByName(new), new


def transcribed(videos: DataFrame, load: Callable[[], Callable[[str], tuple[str, bool, float, float]]], silence: float = 0.7, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(transcripts, to_cache). The model gives (text, has audio, seconds of audio, probability of no speech); text that is probably no speech
    is empty. A video without audio is an empty transcript and is cached; a failure is an empty one too and is not. Each video is heard once."""
    schema = "video_id string, transcript string, audio_present boolean, audio_duration double, failed boolean"
    name = _named(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listen = _model(name, load)
        for pdf in parts:
            rows = []
            for video, path in zip(pdf["video_id"], pdf["video_path"], strict=True):
                try:
                    text, present, seconds, no_speech = listen(path)
                    rows.append((video, text.strip() if present and no_speech < silence else "", bool(present), float(seconds) if present else 0.0, False))
                except Exception:
                    rows.append((video, "", True, 0.0, True))
            yield pd.DataFrame(rows, columns=["video_id", "transcript", "audio_present", "audio_duration", "failed"])

    out = stored(videos.select("video_id", "video_path").mapInPandas(run, schema), "transcripts")
    return out.drop("failed"), out.filter("not failed").drop("failed")


def embedded(frames: DataFrame, load: Callable[[], Callable[[list], np.ndarray]], column: str = "data", batch: int = 16, prepare: Callable[[Any], Any] | None = None, model: str | None = None) -> DataFrame:
    """(video_id, frame_idx, embedding, error), a row for each frame: vectors of unit length. prepare makes of a frame what the model takes.

    A batch that fails is tried frame by frame; a frame that fails, or whose vector has no direction, has a null embedding and an error."""
    name = _named(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = _model(name, load)

        def unit(some: list) -> list[list[float] | None]:
            v = np.asarray(embed([prepare(x) for x in some] if prepare else some), dtype=np.float64)
            length = np.linalg.norm(v, axis=1)
            return [(x / n).astype(np.float32).tolist() if n > 0 else None for x, n in zip(v, length, strict=True)]

        for pdf in parts:
            vectors, errors = [], []
            inputs = pdf[column].tolist()
            for k in range(0, len(inputs), batch):
                some = inputs[k : k + batch]
                try:
                    got = [(v, None if v else "no direction") for v in unit(some)]
                except Exception:
                    got = []
                    for x in some:
                        try:
                            [v] = unit([x])
                            got.append((v, None if v else "no direction"))
                        except Exception as e:
                            got.append((None, f"{type(e).__name__}: {e}"))
                vectors += [v for v, _ in got]
                errors += [e for _, e in got]
            yield pd.DataFrame({"video_id": pdf["video_id"].tolist(), "frame_idx": pdf["frame_idx"].tolist(), "embedding": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    return frames.select("video_id", "frame_idx", column).mapInPandas(run, "video_id string, frame_idx bigint, embedding array<float>, error string")


#: Fixed value: width and height of frames that are sent to a model.
SENT_SIZE = 448


def encoded_frames(frames: DataFrame, encode: Callable[[np.ndarray], bytes] = png, size: int = SENT_SIZE) -> DataFrame:
    """(video_id, frame_idx, image): frames of (height, width, n_channels, data), resized to size x size, encoded, in base64, as image models are sent
    them. encode takes an array of height, width, channels; without one, frames become PNG. Null for a frame that can't be read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            images = []
            for height, width, channels, data in zip(pdf["height"], pdf["width"], pdf["n_channels"], pdf["data"], strict=True):
                try:
                    images.append(base64.b64encode(encode(shrink(np.frombuffer(data, np.uint8).reshape(height, width, channels), size, size))).decode())
                except (TypeError, ValueError):
                    images.append(None)
            yield pd.DataFrame({"video_id": pdf["video_id"].tolist(), "frame_idx": pdf["frame_idx"].tolist(), "image": pd.Series(images, dtype=object)})

    return frames.select("video_id", "frame_idx", "height", "width", "n_channels", "data").mapInPandas(run, "video_id string, frame_idx bigint, image string")


def answered(images: DataFrame, load: Callable[[], Callable[[list], str]], budgets: tuple[int, ...] = (16, 12, 8), model: str | None = None) -> DataFrame:
    """(video_id, frames_selected, actual_frames_used, oom_fallback_triggered, processing_time_s, generated_caption, error), a row for each video of
    (video_id, place, image): one answer for all its frames in order of place, by by_budget(). A video has as many rows as frames were asked for, so a group is small."""
    name = _named(model)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        call = _model(name, load)
        own = [x for x in pdf.sort_values("place")["image"] if x is not None]
        began = time.perf_counter()
        caption, used, fallback = by_budget(call, own, budgets) if own else (None, 0, False)
        error = None if caption is not None else "no frames" if not own else "no budget worked"
        return pd.DataFrame({"video_id": [pdf["video_id"].iloc[0]], "frames_selected": [len(pdf)], "actual_frames_used": [used], "oom_fallback_triggered": [fallback], "processing_time_s": [time.perf_counter() - began], "generated_caption": [caption], "error": [error]})

    schema = "video_id string, frames_selected bigint, actual_frames_used bigint, oom_fallback_triggered boolean, processing_time_s double, generated_caption string, error string"
    return images.select("video_id", "place", "image").groupBy("video_id").applyInPandas(run, schema)


def by_budget(call: Callable[[list], str], frames: list, budgets: tuple[int, ...] = (16, 12, 8)) -> tuple[str | None, int, bool]:
    """(answer, frames used, whether a smaller budget was needed): evenly spaced frames of the largest budget that works."""
    own = [b for b in budgets if b <= len(frames)] or [len(frames)]
    for tries, budget in enumerate(own):
        try:
            return call([frames[k * len(frames) // budget] for k in range(budget)]), budget, tries > 0
        except Exception:
            continue
    return None, 0, True
