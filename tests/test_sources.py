"""Archives and files of a library, made here and read back."""

from __future__ import annotations

import io
import json
import tarfile

import zstandard

from cadenza.sources import archives

KEY = "0a1b2c3d-0000-4000-8000-00000000000{}"


def archive(path, members):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    path.write_bytes(zstandard.ZstdCompressor().compress(raw.getvalue()))


def test_catalogue(spark, tmp_path):
    full = {"metadata": {"tags": {"artist": ["A"], "title": ["T"]}}, "rhythm": {"bpm": 120.5}, "highlevel": {"mood_happy": {"all": {"happy": 0.9}}, "mood_sad": {"all": {"sad": 0.1}}}}
    members = {f"x/{KEY.format(1)}-0.json": json.dumps(full).encode(), f"x/{KEY.format(1)}-1.json": b"{}", f"x/{KEY.format(2)}-0.json": b'{"rhythm": {"bpm": "fast"}}', "x/readme.txt": b"no", "x/odd.json": b"{}"}
    (tmp_path / "sub").mkdir()
    archive(tmp_path / "sub" / "one.tar.zst", members)
    got = {r.mbid: r for r in archives.catalogue(archives.documents(spark, str(tmp_path))).collect()}
    assert got.keys() == {KEY.format(1), KEY.format(2)}
    one, two = got[KEY.format(1)], got[KEY.format(2)]
    assert (one.artist, one.title, one.bpm, round(one.valence, 6), one.energy) == ("A", "T", 120.5, 0.9, 0.5)
    assert (two.bpm, two.valence, two.energy) == (None, 0.5, 0.5)


def test_audio_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/1.mp3", "a/b/2.FLAC", "a/b/cover.jpg"):
        (tmp_path / name).write_bytes(b"123")
    got = {(r.path.rsplit("/", 1)[1], r.size) for r in archives.audio_files(spark, str(tmp_path)).collect()}
    assert got == {("1.mp3", 3), ("2.FLAC", 3)}
