import http.server
import json
import socket
import struct
import threading

import pytest
from pyspark.sql import functions as F

from fathomix import plainyaml
from fathomix.assistant import local_model
from fathomix.cli import main
from fathomix.config import Config, LanguageModel, Security, SettingError, change
from fathomix.functions import paths
from fathomix.guard import OutboundBlocked, is_local, local_only
from fathomix.sources import media
from fathomix.sources.files import ENOUGH, FolderReader, binary_files, decoded


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 9)
    gif = b"GIF89a" + struct.pack("<HH", 3, 4)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 20, 30) + b"\0" * 8
    assert [media.image_size(x) for x in (png, gif, jpeg, b"junk", b"")] == [(7, 9), (3, 4), (30, 20), None, None]
    with pytest.raises(Exception):
        media.read_image(b"junk")


def test_readers_without_decoders_raise():
    for reader in (media.read_pdf, lambda raw: media.read_frames(raw, ".mov")):
        with pytest.raises(Exception):
            reader(b"junk")


def test_paths_of_one_file():
    for path, kind in (("/a/b.TXT", "text"), ("x.tar.gz", "archive"), ("/a/.txt", None), ("/a/b.gz", None), ("b.mp4", "video"), ("/a.d/none", None)):
        assert paths.type_of(path) == kind
    for inner, safe in (("a/b", True), ("/a", True), ("../a", False), ("a/../b", True), ("a/../../b", False), ("\\a", False), ("./a", True), ("a\\..\\..\\b", False)):
        assert paths.is_safe_member(inner) == safe, inner


def test_decoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("aé漢".encode() + b"\xff" + b"b")
    df = binary_files(spark, str(tmp_path))
    assert df.select(decoded(F.col("content"))).first()[0] == "aé漢b"
    assert df.select(decoded(F.col("content"), 5)).first()[0] == "aé"
    assert df.first().mtime_ns > 0 and df.first().path == str(tmp_path / "a.txt")


def test_cli(spark, tmp_path, capsys):
    home = ["--home", str(tmp_path / "home")]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("a walrus sings")
    assert main([*home, "init"]) == 0 and main([*home, "init"]) == 0
    assert main([*home, "config", "set", "roots", str(tmp_path / "docs")]) == 0
    assert main([*home, "config", "set", "search.top", "many"]) == 2 and main([*home, "config", "set", "no.such", "1"]) == 2
    capsys.readouterr()
    assert main([*home, "config", "show", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["roots"] == [str(tmp_path / "docs")]
    assert main([*home, "index", "--dry-run"]) == 0
    assert capsys.readouterr().out.strip().endswith("a.md")
    assert main([*home, "index", "--once"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"indexed": 1}
    assert main([*home, "search", "walrus", "--json", "--no-llm"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["path"].endswith("a.md")
    assert main([*home, "status", "--json"]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["processed"] == 1 and told["index_bytes"] > told["vector_bytes"] > 0 and told["files"][0]["n_files"] == 1
    assert main([*home, "status"]) == 0 and "processed: 1" in capsys.readouterr().out
    assert main([*home, "index", "--rescan"]) == 0 and main([*home, "cleanup", "--all"]) == 0
    assert not any((tmp_path / "home/index").iterdir())


def test_settings(tmp_path):
    config = Config()
    for key, text, want in (("search.w_vec", "0.25", 0.25), ("search.top", " 7 ", 7), ("archives.extract_small", "No", False), ("roots", '"/a,b", /c', ["/a,b", "/c"]), ("models.transcriber", "whisper", "whisper"), ("roots", "", [])):
        change(config, key, text)
        owner = config
        for name in key.split("."):
            owner = getattr(owner, name)
        assert owner == want
    for key, text in (("search", "1"), ("search.none", "1"), ("none.top", "1"), ("search.top", "x"), ("archives.extract_small", "perhaps"), ("roots.x", "1"), ("", "1")):
        with pytest.raises(SettingError):
            change(config, key, text)
    config.roots = ["/with: colon", "- dash", "plain", "true", "12", "it's", 'quo"te', ""]
    config.save(str(tmp_path / "c.yaml"))
    assert Config.read(str(tmp_path / "c.yaml")) == config
    (tmp_path / "d.yaml").write_text("# a comment\nroots:\n- /a  # first\n- '/b # no'\nsearch:\n  top: 3\n  w_vec: 1e-1\n  unknown: 1\nignore: []\narchives:\n    extract_small: false\n")
    with pytest.warns(UserWarning, match="unknown"):
        read = Config.read(str(tmp_path / "d.yaml"))
    assert (read.roots, read.search.top, read.search.w_vec, read.ignore, read.archives.extract_small) == (["/a", "/b # no"], 3, 0.1, [], False)
    with pytest.raises(ValueError):
        plainyaml.load("a:\n  b: 1\n c: 2\n")


def test_only_this_machine():
    assert all(map(is_local, ("localhost", "127.0.0.1", "127.9.9.9", "::1", "[::1]"))) and not any(map(is_local, ("example.org", "10.0.0.1", "0.0.0.0", "127.evil.org")))
    with local_only():
        with pytest.raises(OutboundBlocked):
            socket.create_connection(("192.0.2.1", 80), timeout=0.2)
        with pytest.raises(ConnectionRefusedError), socket.socket() as s:
            s.bind(("127.0.0.1", 0))
            socket.create_connection(("127.0.0.1", s.getsockname()[1]), timeout=0.5)
    with local_only(["192.0.2.1"]), pytest.raises(OSError) as e:
        socket.create_connection(("192.0.2.1", 80), timeout=0.05)
    assert not isinstance(e.value, OutboundBlocked)
    with pytest.raises(OutboundBlocked):
        local_model(LanguageModel(enabled=True, base_url="http://example.org", model="m"), Security())
    assert local_model(LanguageModel(), Security()) is None


def test_model_server(spark):
    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"response": f"{asked['model']}: {asked['prompt']}"}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = local_model(LanguageModel(enabled=True, base_url=f"http://127.0.0.1:{server.server_port}/", model="m", timeout_s=5), Security())
    with local_only():
        assert ask("hello") == "m: hello"
    server.shutdown()


def test_deep_folders_are_shared_out(tmp_path):
    for i in range(9):
        for j in range(9):
            (tmp_path / f"only/a{i}/b{j}/c").mkdir(parents=True)
            (tmp_path / f"only/a{i}/b{j}/c/x.txt").write_text("x")
            (tmp_path / f"only/a{i}/y.txt").write_text("y")
    reader = FolderReader({"roots": str(tmp_path)})
    parts = reader.partitions()
    assert sum(p.value[1] for p in parts) >= ENOUGH
    paths_read = [row[0] for p in parts for row in reader.read(p)]
    assert len(paths_read) == len(set(paths_read)) == 90
