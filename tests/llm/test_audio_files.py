"""Clips and frame groups lie in files, and the rows tell what is read from them."""

import hashlib

import pyarrow as pa

from tabaudit.llm import audio


def test_rows_come_from_stored_clips_and_tensors(spark, tmp_path):
    rows = [(1, "some text " * 2000), (2, None), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in audio.audio_features(docs, folder=f"file://{tmp_path}/a").collect()}
    clips = pa.ipc.open_file(str(next((tmp_path / "a").glob("clips-*")))).read_all().column("media").to_pylist()
    tensors = pa.ipc.open_file(str(next((tmp_path / "a").glob("tensors-*")))).read_all()
    assert [audio.read_clip(c)[1] for c in clips] == [audio.payload(t) for _, t in rows]
    assert tensors.column("mel").type.shape == [audio.FRAMES, audio.MELS]
    assert tensors.column("clip").to_pylist().count(0) == -(-got[1]["n_frames"] // audio.FRAMES) > 1
    for (d, _), clip in zip(rows, clips, strict=True):
        mel, spans = audio.clip_features(clip)
        assert got[d]["media_sha256"] == hashlib.sha256(clip).hexdigest() and got[d]["n_frames"] == len(mel)
        assert got[d]["mel"] == mel.reshape(-1).tolist() and [(s["from_ms"], s["to_ms"]) for s in got[d]["spans"]] == spans
