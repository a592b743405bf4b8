"""Kept state: versions of a store, rounds of a stream that is restarted, ids with a time to live, calls side by side."""

import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from newsdesk.sources import catalog, http, lanes, models, snapshots, workspace
from newsdesk.streaming import rounds, seen
from pyspark.sql import functions as F


class Stopped(Exception):
    pass


def stopping(at):
    """A step hook that stops before the step of this number, and the list of steps that were reached."""
    steps = []

    def step(name):
        steps.append(name)
        if len(steps) > at:
            raise Stopped

    return step, steps


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_a_stop_after_any_step_leaves_the_old_state_or_the_new(spark, tmp_path):
    one, two, three = (spark.createDataFrame([(k,)], "k int").coalesce(1) for k in (1, 2, 3))
    for at in range(20):
        path = str(tmp_path / f"s{at}")
        first = snapshots.Store(spark, path)
        for _ in range(2):  # versions to forget, and folders that nothing names any more
            first.update(lambda base: ({"list": one, "other": one}, {}, {"mark": "old"}))
        step, steps = stopping(at)
        store = snapshots.Store(spark, path, step)
        try:
            store.update(lambda base: ({"list": two}, {"other": three}, {"mark": "new"}))
            store.expire(1, 0.0)
        except Stopped:
            pass
        now = snapshots.Store(spark, path)
        kept = now.newest()
        state = (ids(now.read("list", "k int")), ids(now.read("other", "k int")), kept.facts["mark"])
        assert state == ([2], [1, 3], "new") if "done" in steps else state == ([1], [1], "old")
        # whatever was left behind, the next writer goes on and cleans up
        now.update(lambda base: ({}, {"list": three}, {}))
        now.expire(1, 0.0)
        assert ids(now.read("list", "k int")) == ([2, 3] if "done" in steps else [1, 3])
        named = {f for folders in now.newest().tables.values() for f in folders}
        assert set(os.listdir(f"{path}/data")) - {f for f in os.listdir(f"{path}/data") if f.startswith(".")} == named
        if len(steps) <= at:
            break
    else:
        raise AssertionError("more steps than expected")
    assert steps[:4] == ["write list", "write other", "write manifest", "create manifest"] and len(steps) > 8


def test_of_two_writers_one_starts_again(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"))
    row = lambda k: spark.createDataFrame([(k,)], "k int")
    base = store.newest()
    store.commit(base, {"t": row(1)})
    with pytest.raises(snapshots.Conflict):
        store.commit(base, {"t": row(2)})
    met = []

    def change(now):
        if not met:  # another writer is faster
            store.commit(now, {}, {"t": row(5)})
        met.append(now.version)
        return {}, {"t": row(6)}, {}

    assert store.update(change).version == 3 and met == [1, 2]
    assert ids(store.read("t", "k int")) == [1, 5, 6]
    (tmp_path / "s" / "_manifests" / "4").write_text("{half")  # a manifest that can't be read doesn't count
    assert ids(store.read("t", "k int")) == [1, 5, 6]
    assert store.update(lambda now: ({"t": row(7)}, {}, {})).version == 5 and ids(store.read("t", "k int")) == [7]
    assert store.read("none", "k int").count() == 0


@pytest.mark.parametrize("at", range(5))
def test_cache_tracker_and_list_survive_a_stop(spark, tmp_path, monkeypatch, at):
    cache, tracker, accounts = (str(tmp_path / x) for x in ("cache", "tracker", "accounts"))
    http.save_cache(spark.createDataFrame([("u", "old", None)], http.CACHE), cache)
    workspace.append_tracker(spark.createDataFrame([("a", "t", "s", "2020")], workspace.TRACKER), tracker)
    day = datetime(2026, 4, 6)
    catalog.account_list(spark, accounts, lambda: "- [A](http://a)", day)
    replies = spark.createDataFrame([("u", "body", "new", None)], "url string, body string, etag string, last_modified string")
    markdown = "- [B](http://b)\n- [C](http://c)"
    calls = [
        (http, lambda: http.renew_cache(replies, cache), lambda: [r["etag"] for r in http.load_cache(spark, cache).collect()], ["old"], ["new"]),
        (workspace, lambda: workspace.prune_tracker(spark, tracker, lambda kept: kept.where("false")), lambda: ids(workspace.load_tracker(spark, tracker)), ["a"], []),
        (catalog, lambda: catalog.account_list(spark, accounts, lambda: markdown, day + timedelta(days=8)), lambda: (ids(snapshots.Store(spark, accounts).read("accounts", catalog.ACCOUNTS).select("name")), snapshots.Store(spark, accounts).newest().facts["refreshed"]), (["A"], day.isoformat()), (["B", "C"], (day + timedelta(days=8)).isoformat())),
    ]
    for module, change, state, old, new in calls:
        step, steps = stopping(at)
        with monkeypatch.context() as m:
            m.setattr(module, "Store", lambda spark, path, step=step: snapshots.Store(spark, path, step))
            try:
                change()
            except Stopped:
                pass
        assert state() == (new if "done" in steps else old)


def test_a_pruned_tracker_keeps_what_is_added_meanwhile(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda k: spark.createDataFrame([(k, "t", "s", "2020")], workspace.TRACKER)
    workspace.append_tracker(row("a"), path)
    added = []

    def kept(rows):
        if not added:
            added.append(1)
            workspace.append_tracker(row("b"), path)
        return rows.where("id <> 'a'")

    workspace.prune_tracker(spark, path, kept)
    assert ids(workspace.load_tracker(spark, path)) == ["b"]


# rounds


def feeds(spark, log, name_):
    """A source whose transport notes every request; after the first answer a feed has one more item, then stays as it is."""

    def rss(k, items):
        return "<rss><channel>" + "".join(f"<item><title>{k}-{i}</title><link>https://{k}/{i}</link></item>" for i in items) + "</channel></rss>"

    def transport(url, headers, timeout, relaxed):
        with open(log, "a") as f:
            f.write(json.dumps([url, headers.get("If-None-Match")]) + "\n")
        if url.endswith("down"):
            raise OSError("refused")
        known = headers.get("If-None-Match")
        if known == "b":
            return http.Reply(None, 304)
        return http.Reply(rss(url[-2:], range(2 if known is None else 3)), 200, "a" if known is None else "b")

    class Feeds(rounds.RoundSource):
        fetch = http.Fetcher(transport, attempts=1)

        @classmethod
        def name(cls):
            return name_

    spark.dataSource.register(Feeds)


def requests(log):
    return [tuple(json.loads(x)) for x in open(log).read().splitlines()] if os.path.exists(log) else []


def test_a_restarted_stream_emits_each_item_once(spark, tmp_path):
    log, state, kept = (str(tmp_path / x) for x in ("log", "state", "checkpoint"))
    feeds(spark, log, "test_rounds")
    names = [f"https://f{k}" for k in range(6)] + ["https://down"]
    got, fail = [], []

    def sink(batch, number):
        rows = [(r["round"], r["url"], r["status"], r["etag"]) for r in batch.collect()]
        items = [(r["id"], r["title"]) for r in rounds.articles(batch).collect()]
        if fail:
            fail.pop()
            raise OSError("the sink is down")
        got.append((number, rows, items))

    def run():
        s = spark.readStream.format("test_rounds").option("state", state).option("urls", "\n".join(names)).option("lanes", 3).load()
        s.writeStream.foreachBatch(sink).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()

    run()
    assert sorted(requests(log)) == sorted((u, None) for u in names)
    fail.append(1)
    with pytest.raises(Exception, match="the sink is down"):
        run()
    asked = requests(log)
    assert len(asked) == 2 * len(names)
    run()  # the failed round is run again from what was kept, and no server is asked; then comes the next round
    later = requests(log)
    for x in asked:
        later.remove(x)
    assert all(tag in ("b", None) for _, tag in later) and len(later) in (0, len(names))
    if not later:
        run()
    by_round = {}
    for _, rows, _ in got:
        for n, url, status, tag in rows:
            by_round.setdefault(n, []).append((url, status, tag))
    first, second, third = (sorted(by_round[n]) for n in sorted(by_round)[:3])
    assert first == sorted([*((u, 200, "a") for u in names[:-1]), ("https://down", -1, None)])
    assert second == sorted([*((u, 200, "b") for u in names[:-1]), ("https://down", -1, None)])
    assert third == sorted([*((u, 304, "b") for u in names[:-1]), ("https://down", -1, None)])
    assert [len(items) for _, _, items in got][:3] == [12, 18, 0]  # what is unchanged gives nothing
    assert len({i for _, _, items in got for i, _ in items}) == 18
    assert len(os.listdir(f"{state}/rounds")) <= 3  # earlier rounds are forgotten


def test_files_are_created_once(tmp_path):
    f = rounds.Folder(str(tmp_path))
    assert f.read("a/b") is None and f.names("a") == []
    f.create("a/b", [{"x": 1}, {"x": "é\n"}])
    f.create("a/b", [{"x": 2}])
    assert f.read("a/b") == [{"x": 1}, {"x": "é\n"}] and f.names("a") == ["b"]
    f.remove("a")
    assert f.names("a") == []


# seen ids


def test_seen_ids_of_stream_and_batch_agree(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2026, 1, 1)
    rows = sorted((start + timedelta(hours=rng.randint(0, 60 * 24)), rng.choice("abcdefgh")) for _ in range(160))
    rows += [(rows[-1][0] + timedelta(days=200), "z")]
    made = spark.createDataFrame([(x, f"title {k}", "s", k, at) for k, (at, x) in enumerate(rows)], "id string, title string, source string, pos long, ts timestamp")
    for k in range(0, len(rows), 40):
        made.where(f"pos >= {k} AND pos < {k + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ttl = timedelta(days=4)

    def streamed(name, renews):
        with seen.keyed_state(spark):
            s = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = str(tmp_path / name)
            seen.tracked(s, ttl, renews=renews).writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(seen.EVENT).parquet(out).collect())

    got = streamed("renewed", True)
    until = rows[-1][0] - timedelta(hours=1)
    want = sorted(tuple(r) for r in seen.tracked_batch(made, ttl, until=until).collect())
    assert got == want and sum(r[1] == "removed" for r in got) > 10
    # without renewal: the time of the first sighting counts
    kept, events = {}, []
    for k, (at, x) in enumerate(rows):
        if x in kept and at - kept[x][1] > ttl:
            events.append((x, "removed", kept[x][0], "s", kept.pop(x)[1]))
        if x not in kept:
            kept[x] = (f"title {k}", at)
            events.append((x, "new", f"title {k}", "s", at))
    events += [(x, "removed", t, "s", at) for x, (t, at) in kept.items() if at + ttl < until]
    assert streamed("fixed", False) == sorted(events)
    assert seen.tracked_batch(made.where("false"), ttl).count() == 0


def test_seen_ids_states_come_with_the_rows():
    """One state and one time limit an id, and no call to a state store: a stand-in of the state that comes with the rows is enough."""
    import pandas as pd

    class State:
        value, limit, hasTimedOut, mark = None, None, False, 0
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)
        update = lambda self, v: setattr(self, "value", v)
        remove = lambda self: setattr(self, "value", None)
        getCurrentWatermarkMs = lambda self: self.mark
        setTimeoutTimestamp = lambda self, at: setattr(self, "limit", at)

    each, state = seen._follow(timedelta(milliseconds=10), True), State()
    batch = lambda *rows: pd.DataFrame(rows, columns=["id", "title", "source", "pos", "micros"])
    run = lambda *frames: [tuple(r) for f in each(("a",), iter(frames), state) for r in f.itertuples(index=False)]
    assert run(batch(("a", "second", "s", 2, 5000)), batch(("a", "first", "s", 1, 5000))) == [("a", "new", "first", "s", 5000)]
    assert (state.value, state.limit) == (("first", "s", 5000), 15)
    assert run(batch(("a", "later", "s", 3, 9000))) == [] and (state.value, state.limit) == (("first", "s", 9000), 19)
    assert run(batch(("a", "again", "s", 4, 19_001))) == [("a", "removed", "first", "s", 9000), ("a", "new", "again", "s", 19_001)]
    state.hasTimedOut = True
    assert run() == [("a", "removed", "again", "s", 19_001)] and state.value is None
    state.hasTimedOut, state.mark = False, 60
    assert run(batch(("a", "late", "s", 5, 45_000))) == [("a", "new", "late", "s", 45_000), ("a", "removed", "late", "s", 45_000)] and not state.exists


# calls side by side


def spans(folder):
    """(process, begin, end) of each call that was noted."""
    return [tuple(json.loads(open(f"{folder}/{x}").read())) for x in os.listdir(folder)]


def noted(folder, seconds=0.15):
    os.makedirs(folder)

    def call(name):
        began = time.time()
        time.sleep(seconds)
        with open(f"{folder}/{name}", "w") as f:
            json.dump([os.getpid(), began, time.time(), name], f)

    return call


def most_at_once(found):
    return max(sum(b <= x < e for _, b, e, *_ in found) for _, x, *_ in found)


def test_requests_run_in_lanes_and_threads(spark, tmp_path):
    call = noted(str(tmp_path / "calls"))

    def transport(url, headers, timeout, relaxed):
        call(url.split("//")[1].replace("/", "_"))
        return http.Reply(url, 200)

    urls_ = spark.createDataFrame([(f"https://h{k}.com/x", k) for k in range(268)], "url string, k int").coalesce(1)
    out = http.fetched(urls_, None, http.Fetcher(transport, attempts=1), lanes=8, at_once=3)
    assert out.rdd.getNumPartitions() == 8
    tasks = out.withColumn("task", F.spark_partition_id()).select("task", "url", "body", "k").collect()
    assert len({r["task"] for r in tasks}) == 8 and all(r["url"] == r["body"] == f"https://h{r['k']}.com/x" for r in tasks)
    found = spans(tmp_path / "calls")
    assert len(found) == 268 and 3 < most_at_once(found) <= 24
    for pid in {p for p, *_ in found}:
        assert most_at_once([f for f in found if f[0] == pid]) <= 3


def test_a_host_is_never_hurried(spark, tmp_path):
    call = noted(str(tmp_path / "calls"), 0.05)

    def transport(url, headers, timeout, relaxed):
        call(url.split("//")[1].replace("/", "_"))
        return http.Reply("b", 200)

    urls_ = spark.createDataFrame([(f"https://h{k % 3}.com/{k}",) for k in range(12)], "url string")
    assert http.fetched(urls_, None, http.Fetcher(transport, attempts=1), 0.2, lanes=4, at_once=4).count() == 12
    found = spans(tmp_path / "calls")
    for h in range(3):
        begun = sorted(b for _, b, _, name in found if name.startswith(f"h{h}."))
        assert len(begun) == 4 and all(y - x >= 0.19 for x, y in zip(begun, begun[1:], strict=False))


def test_models_are_asked_side_by_side_in_order(spark, tmp_path):
    call = noted(str(tmp_path / "calls"))

    def answer(prompt, profile):
        call(prompt)
        return prompt.upper()

    asked = spark.createDataFrame([(f"p{k}", k) for k in range(100)] + [(None, -1)], "prompt string, k int").coalesce(1)
    rows = models.ask(asked, "prompt", answer, lanes=4, at_once=3).collect()
    assert len(rows) == 101 and all(r["response"] == (None if r["k"] < 0 else f"P{r['k']}") for r in rows)
    found = spans(tmp_path / "calls")
    assert 3 < most_at_once(found) <= 12
    for pid in {p for p, *_ in found}:
        assert most_at_once([f for f in found if f[0] == pid]) <= 3


def test_pace_and_groups():
    now, waits = [0.0], []

    def pause(s):
        waits.append(round(s, 6))
        now[0] += s

    pace = lanes.Pace(2.0, 2, pause, lambda: now[0])
    for _ in range(4):
        pace.wait("a")
    pace.wait("b")
    assert waits == [2.0, 2.0]
    now[0] += 100
    for _ in range(3):
        pace.wait("a")
    assert waits == [2.0, 2.0, 2.0]
    running, worst = set(), []

    def call(x):
        worst.append(x[0] in running)
        running.add(x[0])
        time.sleep(0.01)
        running.discard(x[0])
        return x

    items = [("ab"[k % 2], k) for k in range(20)]
    assert lanes.side_by_side(call, items, 8, lambda x: x[0]) == items and not any(worst)
    with pytest.raises(ZeroDivisionError):
        lanes.side_by_side(lambda x: 1 // x, [1, 0], 2)
    assert lanes.side_by_side(call, [], 4) == []


def test_tables_of_a_context_go_at_its_end(spark):
    from newsdesk import storage
    from newsdesk.operators import dedup

    def row():
        return storage.stored(spark.range(3), "x")

    there = lambda t: t.newsdesk_path in storage._paths
    with storage.scratch() as lasting:
        a = row()
        with storage.scratch() as inner:
            b, c = row(), inner(row())
        assert there(a) and not there(b) and there(c) and c.count() == 3
        d = lasting(row())
    assert not there(a) and not there(c) and there(d) and d.count() == 3
    before = len(storage._paths)
    articles = spark.createDataFrame([(k, f"title number {k % 7} of these", f"https://e.com/{k % 11}") for k in range(40)], "pos long, title string, url string")
    assert dedup.greedy(articles).count() == 7 and len(storage._paths) == before + 1
