"""Directory trees: crawl, store, update, merge, crash safety, watching."""

import json
import os
import random

import pytest
from lexiquarry import cli
from lexiquarry.engine import Engine, Root
from lexiquarry.operators.merge import MergePolicy, plan_merges
from lexiquarry.sources.crawl import CrawlConfig, crawl, crawl_stats, looks_binary
from lexiquarry.sources.ignore import Rules, ignored
from lexiquarry.sources.store import Files, Incompatible, Locked, NoIndex, Segment
from lexiquarry.streaming.watch import CLOSED, HINT, Governor, watch


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture
def tree(tmp_path):
    put(tmp_path, ".gitignore", "ignored/\n*.log\n")
    put(tmp_path, "README.md", "# Title\nThis is a test project. Hello world.\n")
    put(tmp_path, "src/main.rs", "fn main() { parse_http_response() -> HttpResponse; }\nfn other() {}\n")
    put(tmp_path, "src/_lib.rs", "struct HttpResponse; let snake_case_name = 1; // naïve café résumé\n")
    put(tmp_path, ".hidden/notes.txt", "hidden hello")
    put(tmp_path, "big.txt", "hello world " * 20)
    put(tmp_path, "bad_utf8.txt", b"abc \xff\xfe def")
    put(tmp_path, "bin.dat", b"a\0b")
    put(tmp_path, "bom.txt", b"\xef\xbb\xbfmarked")
    for gone in ("ignored/secret.txt", "debug.log", ".git/config"):
        put(tmp_path, gone, "hello world")
    return tmp_path


def names(root, query):
    docs = {r.doc_id: r.path for r in root.store.docs().collect()}
    return sorted(docs[r.doc_id] for r in root.search(query).every.collect())


def test_crawl(spark, tree):
    stats = crawl_stats(crawl(spark, str(tree), CrawlConfig(max_file_size=200))).first()
    assert (stats.files_seen, stats.too_large, stats.binary, stats.indexable) == (9, 1, 1, 7)
    with pytest.raises(NotADirectoryError):
        crawl(spark, str(tree / "README.md"))
    assert looks_binary(b"a\0") and not looks_binary(b"a" * 9000 + b"\0")


def test_ignore_rules():
    rules = [Rules("", "*.log\n!keep.log\n/top\nbuild/\nsub/*.txt\n**/deep\n# no\n\\#yes\na?c\n[xy]z\n"), Rules("in", "!b.log\n")]
    yes = ["a.log", "x/a.log", "top", "sub/a.txt", "p/q/deep", "#yes", "abc", "xz"]
    no = ["keep.log", "x/top", "build", "sub/x/a.txt", "in/b.log", "no", "az"]
    assert [p for p in yes if not ignored(p, False, rules)] == [] and [p for p in no if ignored(p, False, rules)] == []
    assert ignored("build", True, rules)


def test_build_search_update_merge(spark, tree):
    root = Root(spark, str(tree))
    stats = root.build()
    assert (stats["docs_total"], stats["docs_indexed"], stats["docs_skipped"]) == (9, 7, 2)
    assert names(root, "hello") == ".hidden/notes.txt README.md big.txt".split()
    assert names(root, "http response") == ["src/_lib.rs", "src/main.rs"] and names(root, '"parse http"') == ["src/main.rs"]
    assert names(root, "café") == ["src/_lib.rs"] and names(root, "marked") == ["bom.txt"] and names(root, "secret") == []
    assert root.verify() == []
    shown = {r.path: r.snippet for r in root.show("hello").collect()}
    assert shown["README.md"] == "This is a test project. [Hello] world."
    assert root.update() == {"deletes": 0, "patches": 0, "reindexes": 0, "built": False, "generation": 1}
    os.rename(tree / "README.md", tree / "READ.md")  # a patch, nothing read anew
    put(tree, "big.txt", "changed content")
    os.remove(tree / ".hidden/notes.txt")
    put(tree, "new.txt", "hello again")
    got = root.update()
    assert (got["deletes"], got["patches"], got["reindexes"], got["generation"]) == (2, 1, 2, 2)
    assert names(root, "hello") == ["READ.md", "new.txt"] and names(root, "changed") == ["big.txt"]
    os.utime(tree / "new.txt", ns=(1, 1))
    assert root.update()["patches"] == 1
    with root.store.snapshot() as before:
        assert root.delete([10_000]) is None
        doc = next(r.doc_id for r in root.store.docs().collect() if r.path == "new.txt")
        root.delete([doc])
        assert root.store.docs(before).where(f"doc_id = {doc}").count() == 1  # a snapshot stays as it was
    assert names(root, "hello") == ["READ.md"]
    prepared = root.prepare_merge(MergePolicy(max_deleted=0.2, min_members=9))
    gone = next(r.doc_id for r in root.store.docs().collect() if r.path == "src/main.rs")
    root.delete([gone])  # while the merge is being written
    assert root.commit_merges(prepared) >= 1
    assert names(root, "http response") == ["src/_lib.rs"] and names(root, "hello") == ["READ.md"] and root.verify() == []


def test_random_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    words = "alpha beta gamma delta parseThis x_x".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(4))
    for i in range(6):
        put(tmp_path, f"f{i}.txt", text())
    root = Root(spark, str(tmp_path))
    root.build()
    for step in range(3):
        for _ in range(3):
            have = sorted(p.name for p in tmp_path.glob("*.txt"))
            what = rng.choice(["create", "modify", "delete", "rename"])
            if what == "create" or len(have) < 3:
                put(tmp_path, f"n{step}{rng.random():.6f}.txt", text())
            elif what == "modify":
                put(tmp_path, rng.choice(have), text() + " longer")
            elif what == "delete":
                os.remove(tmp_path / rng.choice(have))
            else:
                os.rename(tmp_path / rng.choice(have), tmp_path / f"r{step}{rng.random():.6f}.txt")
        root.update()
    queries = ["alpha", "beta OR parse", '"alpha beta"', "x -gamma", "this delta"]
    got = [names(root, q) for q in queries]
    paths = sorted(r.path for r in root.store.docs().collect())
    root.build()
    assert paths == sorted(r.path for r in root.store.docs().collect()) == sorted(p.name for p in tmp_path.glob("*.txt"))
    assert got == [names(root, q) for q in queries]


class Failing(Files):
    def __init__(self, at):
        super().__init__()
        self.left = at

    def _count(self, f, *a):
        self.left -= 1
        if self.left < 0:
            raise OSError("injected")
        return f(*a)

    def write(self, *a):
        self._count(super().write, *a)

    def rename(self, *a):
        self._count(super().rename, *a)

    def sync(self, *a):
        self._count(super().sync, *a)


def test_a_commit_is_old_or_new(spark, tmp_path):
    put(tmp_path, "a.txt", "alpha beta")
    put(tmp_path, "b.txt", "beta gamma")
    root = Root(spark, str(tmp_path))
    root.build()
    old, states = names(root, "beta"), set()
    for at in range(4):
        put(tmp_path, "a.txt", "alpha changed" + " x" * at)
        root.store.files = Failing(at)
        with pytest.raises(OSError, match="injected"):
            root.update()
        root.store.files = Files()
        again = Root(spark, str(tmp_path))
        states.add(tuple(names(again, "beta")))
        assert again.verify() == []
    assert states <= {tuple(old), ("b.txt",)} and tuple(old) in states
    root.update()
    assert names(root, "changed") == ["a.txt"]


def test_store_faults(spark, tmp_path):
    root = Root(spark, str(tmp_path))
    with pytest.raises(NoIndex):
        root.stats()
    put(tmp_path, "a.txt", "alpha")
    root.build()
    with root.store.lock(), pytest.raises(Locked), Root(spark, str(tmp_path)).store.lock(0.05):
        pass
    stray = tmp_path / ".lexiquarry" / "seg-stray"
    stray.mkdir()
    assert root.store.sweep() == ["seg-stray"]
    manifest = tmp_path / ".lexiquarry" / "MANIFEST"
    good = manifest.read_text()
    manifest.write_text("{broken")
    assert root.store.manifest() is None and root.store.sweep() == []
    manifest.write_text(json.dumps({**json.loads(good), "version": 99}))
    with pytest.raises(Incompatible):
        root.store.manifest()
    manifest.write_text(good)
    part = next((tmp_path / ".lexiquarry").rglob("postings/*/*.parquet"))
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 2 :] = b"\0" * (len(raw) - len(raw) // 2)
    part.write_bytes(bytes(raw))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert root.verify()


def test_merge_plan():
    mib = 1 << 20
    s = lambda name, deleted=0, size=mib: Segment(name, 0, 100, 0, deleted, size)
    groups = lambda xs, p=MergePolicy(): [[x.name for x in g] for g in plan_merges(xs, p)]
    assert groups([s("a"), s("b"), s("c")]) == [] and groups([s(x) for x in "abcd"]) == [["a", "b", "c", "d"]]
    assert groups([s("x", 31), s("y", 30)]) == [["x"]]
    assert groups([s(str(i)) for i in range(11)]) == [[str(i) for i in range(10)]]
    assert groups([s(str(i), 0, 513 * mib) for i in range(5)]) == [] and groups([s(str(i), 0, 512 * mib) for i in range(4)]) == [["0", "1", "2", "3"]]


def test_engine_and_protocol(spark, tmp_path):
    for name, body in (("r1/a.txt", "alpha beta"), ("r2/b.txt", "alpha gamma gamma")):
        put(tmp_path, name, body)
    engine = Engine(spark)
    for r in ("r1", "r2", "r1"):
        engine.add_root(str(tmp_path / r))
    assert engine.list_roots() == [str(tmp_path / "r1"), str(tmp_path / "r2")]
    assert engine.search("alpha").total() == 2 and engine.search("alpha", roots=[str(tmp_path / "r2")]).total() == 1
    assert engine.status().count() == 2
    out = [json.loads(x) for x in engine.handle_line(json.dumps(dict(id=7, method="Query", params=dict(query="gamma"))))]
    assert out[0]["type"] == "Hit" and out[-1] == {"id": 7, "type": "Done", "total": 1}
    assert json.loads(engine.handle_line(json.dumps(dict(id=8, method="Query", params=dict(query="-x"))))[0])["type"] == "Error"
    assert json.loads(engine.handle_line("not json")[0])["id"] is None
    assert json.loads(engine.handle_line('{"id": 1, "method": "ListRoots"}')[0])["result"] == engine.list_roots()
    assert engine.remove_root(str(tmp_path / "r2")) and not engine.remove_root(str(tmp_path / "r2"))


def test_cli(spark, tmp_path, capsys):
    put(tmp_path, "a.txt", "alpha beta\n")
    for argv in (["index", str(tmp_path)], ["search", "alpha", "--root", str(tmp_path)], ["verify", str(tmp_path)], ["update", str(tmp_path)], ["merge", str(tmp_path)], ["status", str(tmp_path), "--json"]):
        assert cli.main(argv, spark) == 0, argv
    out = capsys.readouterr().out
    assert "a.txt:1" in out and "[alpha] beta" in out and "ok" in out
    assert cli.main(["search", "(x", "--root", str(tmp_path)], spark) == 2
    assert cli.main(["verify", str(tmp_path / "none")], spark) == 1


class Script:
    """Events at given times on a clock that only waiting moves."""

    def __init__(self, *events):
        self.events, self.t = list(events), 0.0

    def now(self):
        return self.t

    def wait(self, timeout):
        if self.events and self.events[0][0] <= self.t + timeout:
            at, e = self.events.pop(0)
            self.t = max(self.t, at)
            return e
        self.t += max(timeout, 0.001)
        return None


def runs(*events, **k):
    s, times = Script(*events), []
    n = watch(s, lambda: times.append(round(s.t, 1)), clock=s, **k)
    assert n == len(times)
    return times


def test_watch_schedule():
    assert runs((1, CLOSED)) == [0.0]
    assert runs((1, HINT), (1.2, HINT), (1.4, HINT), (9, CLOSED)) == [0.0, 1.9]
    assert runs((1, HINT), (3, HINT), (9, CLOSED)) == [0.0, 1.5, 3.5]
    assert runs((700, CLOSED)) == [0.0, 600.0]
    steady = [(i * 0.3, HINT) for i in range(1, 60)]
    assert runs(*steady, (20, CLOSED), periodic=5.0)[1] <= 5.1


def test_governor():
    t = [0.0]

    def sleep(s):
        t[0] += s

    g = Governor(bytes_per_second=100, duty=0.5, now=lambda: t[0], sleep=sleep)
    assert g.spend(100) == 0 and g.spend(50) == 0.5 and g.rest(2.0) == 2.0
    paused = iter([True, False])
    assert Governor(duty=1.0, now=lambda: 0, sleep=sleep, must_pause=lambda: next(paused)).rest(1.0) == 30.0
