"""The whole run on a small library of sines, and the command line."""

import base64
import hashlib
import wave

import numpy as np
import pytest

from phonolith import cli
from phonolith.errors import CollectionError, LibraryError
from phonolith.plans import process as plans
from phonolith.sources import collection, files, logs, wav


def audio_id(n):
    return base64.b64encode(hashlib.md5(bytes([n])).hexdigest().encode() * 8).decode()


@pytest.fixture
def library(tmp_path, spark):
    music = tmp_path / "Music +% é"
    music.mkdir()
    entries = []
    for n, name in enumerate(["01 - Some One - Tune.wav", "Other.wav", "silent.wav", "unknown.wav"]):
        t = np.arange(5000)
        x = (0 if name == "silent.wav" else 6000) * np.sin(2 * np.pi * (n + 3) * t / 500)
        (music / name).write_bytes(wav.encode(np.stack([x, x / 2], 1).astype(np.int16), 1000))
        if name != "unknown.wav":
            folder = "/:" + str(music).strip("/").replace("/", "/:") + "/:"
            entries.append(f'<ENTRY AUDIO_ID="{audio_id(n)}" TITLE="{"" if n else "Tune 2"}"><LOCATION DIR="{folder}" FILE="{name}" VOLUME="v"/>' + ('<INFO FLAGS="12"/>' if n == 0 else "") + "</ENTRY>")
    (music / "notes.txt").write_text("x")
    path = tmp_path / "collection.nml"
    path.write_text(f'<?xml version="1.0" encoding="UTF-8"?><NML><HEAD x="1"/><COLLECTION>{"".join(entries)}<ENTRY TITLE="nowhere"/></COLLECTION></NML>', encoding="utf-8")
    return tmp_path, music, path


def settings(library, **more):
    root, music, path = library
    return plans.Settings(str(music), str(root / "Outputs"), collection=str(path), state_dir=str(root / "jobs"), segment=0.9, overlap=0.3, sample_rate=1000, continue_on_error=True, **more)


def test_process_end_to_end(spark, library):
    root, music, path = library
    dry = {r["path"]: r["status"] for r in plans.process(spark, settings(library, dry_run=True)).collect()}
    assert sorted(dry.values()) == ["error", "planned", "planned", "planned"] and not (root / "Outputs").exists()
    got = {r["path"].rsplit("/", 1)[1]: r for r in plans.process(spark, settings(library)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"01 - Some One - Tune.wav": "done", "Other.wav": "done", "silent.wav": "done", "unknown.wav": "error"}
    assert got["silent.wav"]["message"] == "silent master" and got["Other.wav"]["message"] == "corr=1.000, rms_ratio=1.000"
    with wave.open(plans.pcm_path(got["Other.wav"]["output"]), "rb") as w:
        x = np.frombuffer(w.readframes(10**6), "<i2").reshape(-1, 10) / 32767
    assert len(x) == 5000
    # The stand-in's shares survive chunking and overlap-add, channel by channel.
    for slot, share in enumerate((0.4, 0.3, 0.2, 0.1)):
        assert np.abs(x[:, 2 + 2 * slot] - share * x[:, 0]).max() < 1e-3 and np.abs(x[:, 3 + 2 * slot] - share * x[:, 1]).max() < 1e-3
    flags = [r["flags"] for r in collection.read_ordered(spark, str(path)).orderBy("pos").collect()]
    assert flags == [76, 64, 64] and (root / "collection.nml.bak").exists()
    assert "<HEAD" in path.read_text(encoding="utf-8")
    again = {r["path"].rsplit("/", 1)[1]: r["status"] for r in plans.process(spark, settings(library)).collect()}
    assert again == {"01 - Some One - Tune.wav": "skipped", "Other.wav": "skipped", "silent.wav": "skipped", "unknown.wav": "error"}
    assert not (root / "collection.nml.bak1").exists()  # nothing changed


def test_a_broken_file_fails_alone_and_unready_outputs_are_made_again(spark, library):
    root, music, path = library
    whole = (music / "Other.wav").read_bytes()
    (music / "Other.wav").write_bytes(whole[:20])
    got = {r["path"].rsplit("/", 1)[1]: r for r in plans.process(spark, settings(library)).collect()}
    assert got["Other.wav"]["status"] == "error" and "cannot decode" in got["Other.wav"]["message"]
    assert got["silent.wav"]["status"] == "done" and got["01 - Some One - Tune.wav"]["status"] == "done"
    (music / "Other.wav").write_bytes(whole)
    out = plans.pcm_path(got["silent.wav"]["output"])
    with open(out, "r+b") as f:  # without its metadata a file is not ready
        f.seek(-10, 2)
        f.truncate()
    again = {r["path"].rsplit("/", 1)[1]: r["status"] for r in plans.process(spark, settings(library)).collect()}
    assert again == {"01 - Some One - Tune.wav": "skipped", "Other.wav": "done", "silent.wav": "done", "unknown.wav": "error"}


def test_shifts_and_discovery(spark, library):
    """The stand-in gives the same at every place of the grid; the collection and its log are found where none is named."""
    root, music, path = library
    folder = root / "Deck 3.10"
    (folder / "Logs").mkdir(parents=True)
    (folder / "collection.nml").write_bytes(path.read_bytes())
    (folder / "Logs" / "Deck.log").write_text(f'Finished stem separation job for track "Other" - result: successful: stem file stored to "{root}/Outputs/logged.stem.mp4", with offset 0us\n')
    s = plans.Settings(str(music), str(root / "Outputs"), library_root=str(root), library_app="Deck", segment=0.9, overlap=0.3, sample_rate=1000, shifts=3, update_collection=False)
    got = {r["path"].rsplit("/", 1)[1]: r for r in plans.process(spark, s).collect()}
    assert got["Other.wav"]["output"].endswith("/Outputs/logged.stem.mp4") and got["Other.wav"]["status"] == "done"
    with wave.open(plans.pcm_path(got["Other.wav"]["output"]), "rb") as w:
        x = np.frombuffer(w.readframes(10**6), "<i2").reshape(-1, 10) / 32767
    assert len(x) == 5000 and np.abs(x[:, 2] - 0.4 * x[:, 0]).max() < 1e-3
    with pytest.raises(CollectionError):
        plans.Settings("a", "b", library_root=str(root), library_app="None").located(spark)


@pytest.mark.parametrize("rate", [500, 1000, 1500, 44100])
def test_resampling(spark, library, rate):
    """Every block size gives what interpolating the whole signal gives."""
    root, music, path = library
    files_ = files.contents(spark, str(music), "Other.wav")
    x = np.frombuffer((music / "Other.wav").read_bytes()[44:], "<i2").reshape(-1, 2)[:, 0] / 2**15
    want = np.interp(np.arange((len(x) - 1) * rate // 1000 + 1) * 1000 / rate, np.arange(len(x)), x)
    for size in (700, 1 << 16):
        got = wav.blocks(files_, size, rate).where("channel = 0").orderBy("block").collect()
        y = np.concatenate([r["samples"] for r in got])
        assert len(y) == len(want) and np.abs(y - want).max() < 1e-4


def test_sources(spark, library):
    root, music, path = library
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.scan(spark, str(music)).collect()) == ["01 - Some One - Tune.wav", "Other.wav", "silent.wav", "unknown.wav"]
    assert {tuple(r)[1:] for r in files.wav_info(spark, str(music)).collect()} == {(2, 2, 1000, 5000)}
    a = sorted(tuple(r) for r in collection.read(spark, str(path)).select("path", "audio_id").collect())
    b = sorted(tuple(r) for r in collection.read_ordered(spark, str(path)).select("path", "audio_id").collect())
    assert a == b and len(a) == 3
    log = root / "app.log"
    log.write_bytes(b'noise\r\nx Finished stem separation job for track "A" - result: successful: stem file stored to "/S/1", with offset 0us, elapsed\x0bmore \xff')
    assert [tuple(r) for r in logs.entries(logs.lines(spark, str(log))).collect()] == [(1, "A", "/S/1", "0us")]
    assert logs.lines(spark, str(root / "none.log")).count() == 0
    assert logs.log_path("/a/b/c.nml", "App") == "/a/b/Logs/App.log"


def test_discover_and_broken_collection(spark, tmp_path):
    for v in ("3.9", "3.10", "x"):
        (tmp_path / f"Deck {v}").mkdir()
        (tmp_path / f"Deck {v}" / "collection.nml").write_text("<a/>")
    assert collection.discover(spark, str(tmp_path), "Deck").endswith("Deck 3.10/collection.nml")
    assert collection.discover(spark, str(tmp_path), "None") is None
    (tmp_path / "bad.nml").write_text("<a>")
    with pytest.raises(CollectionError):
        collection.CollectionFile(str(tmp_path / "bad.nml"))


def test_settings_are_checked():
    for bad in ({"overlap": 1.0}, {"batch_size": -1}, {"limit": -1}, {"profile": "x"}, {"algorithm": "x"}, {"segment": 0}):
        with pytest.raises((LibraryError, ValueError)):
            plans.Settings("a", "b", **bad).check()


def test_command_line(spark, library, capsys):
    root, music, path = library
    assert cli.main(["doctor"]) == 0
    assert cli.main(["scan", "--music-dir", str(music), "--collection", str(path), "--limit", "2"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[-1] == "total: 4" and out[-3].startswith("matched\tSome One - Tune 2\t")
    where = ["--output-dir", str(root / "Outputs"), "--collection", str(path)]
    assert cli.main(["calibrate", "--audio", str(music / "Other.wav"), "--stem-file", "/x/y.stem.mp4", *where]) == 0
    assert capsys.readouterr().out.splitlines()[-1].endswith("\tno")
    assert cli.main(["calibrate", "--audio", "/none.wav", *where]) == 1
    assert cli.main(["process", "--music-dir", str(music), "--dry-run", "--continue-on-error", *where]) == 0
    assert cli.main(["process", "--music-dir", str(music), "--overlap", "2", *where]) == 1
    (root / "x.mp4").write_bytes(b"")
    assert cli.main(["verify", str(root / "x.mp4")]) == 2


def test_streaming(spark, library, tmp_path):
    from phonolith import streaming
    from phonolith.operators.jobs import JobLog

    root, music, path = library
    log = JobLog(spark, str(tmp_path / "stream-jobs"))
    found = streaming.new_files(spark, str(music)).selectExpr("path", "size", "'pending' status")
    q = streaming.record(found, log, str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert log.latest().count() == 4
