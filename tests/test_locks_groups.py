"""Hand-made cases of lock details, receive latency, cache history and work groups."""

import datetime as dt

from tempolens.plans import counter_reports as CR
from tempolens.plans import locks as LK
from tempolens.plans import queue_reports as Q
from tempolens.plans import sessions as SS
from tempolens.plans import storage as SG

T = [dt.datetime(2024, 1, 1, h) for h in range(6)]


def test_lock_details_names_what_is_waited_for(spark):
    locks = spark.createDataFrame([(1, 10, "TX", 5, 6, 0, 6, 30), (1, 11, "TM", 7, 0, 3, 0, 4), (1, 12, "TX", 5, 6, 0, 6, 1), (1, 13, "AE", 1, 0, 4, 0, 9)],
                                  "inst_id int, sid long, lock_type string, id1 long, id2 long, lmode int, request int, ctime long")
    row = "inst_id int, sid long, serial_no long, session_type string, status string, username string, os_user string, machine string, process string, " \
          "program string, module string, sql_id string, process_addr long, transaction_addr long, lock_wait long, p2text string, p2 long, row_wait_obj long, " \
          "seconds_in_wait long, blocking_instance int, blocking_session long"

    def session(sid, kind="USER", tx=None, wait=None, p2text="id2", p2=0, obj=-1, blocker=None):
        return (1, sid, sid * 2, kind, "ACTIVE", "U", "o", "m", "p", "prog", "mod", "s", sid, tx, wait, p2text, p2, obj, 3, 1 if blocker else None, blocker)
    sessions = spark.createDataFrame([session(10, wait=1, p2text="object #", p2=5, obj=7, blocker=11), session(11, tx=99, wait=1, obj=7), session(12, "BACKGROUND"),
                                      session(13), session(14)], row)
    processes = spark.createDataFrame([(1, n, f"pid{n}") for n in (10, 11, 12)], "inst_id int, addr long, spid string")
    transactions = spark.createDataFrame([(1, 99, 4), (2, 99, 5)], "inst_id int, addr long, rollback_segment int")
    objects = spark.createDataFrame([(5, "OWN", "ORDERS", "TABLE"), (7, "OWN", "ITEMS", "TABLE")], "object_id long, owner string, object_name string, object_type string")
    out = {r.sid: r for r in SS.lock_details(locks, sessions, processes, transactions, objects).collect()}
    assert set(out) == {10, 11}  # 12 is no user session, 13 holds a type left out
    assert out[10].waiting_for_object == "OWN.ORDERS" and out[10].blocking_serial_no == 22 and out[10].rollback_segment is None
    assert out[11].waiting_for_object is None and out[11].rollback_segment == 4 and out[11].locked_object_owner == "own"
    assert out[10].inst_pid_user == "1:pid10:U" and out[10].client == "m(o):p:prog" and out[10].id1_id2 == "5:6"
    one = SS.lock_details(locks, sessions, processes, transactions, objects, instance=1, sid=13, skip_types=())
    assert one.count() == 0  # no process
    assert SS.lock_details(locks, sessions, processes, transactions, objects, instance=1, sid=11).count() == 1


def test_latency_now_needs_both_statistics(spark):
    t, b = "gc cr block receive time", "gc cr blocks received"
    rows = [(1, t, 50), (1, b, 100), (2, t, 7), (2, b, 0), (3, t, 1), (4, "other", 1)]
    out = CR.latency_now(spark.createDataFrame(rows, "inst_id int, stat_name string, value long")).collect()
    assert {r.inst_id: r.avg_receive_time_ms for r in out} == {1: 5.0, 2: 70.0}


def test_latency_objects_sums_objects_of_one_name(spark):
    seg = spark.createDataFrame([(1, 1, 3, 1, 5), (1, 1, 4, 2, 6), (1, 1, 9, 1, 100), (1, 2, 3, 1, 100), (1, 1, 3, 3, 0), (1, 1, 3, 9, 5)],
                                "dbid int, instance_number int, snap_id int, obj long, gc_cr_blocks_received_delta long")
    names = spark.createDataFrame([(1, "O", "A", None), (2, "O", "A", None), (3, "O", "B", None)], "object_id long, owner string, object_name string, subobject_name string")
    out = CR.latency_objects(seg, names, 1, 1, 3, 4, ["gc_cr_blocks_received_delta"]).collect()
    assert [tuple(r) for r in out] == [("O", "A", None, 11)]


def test_running_groups_count_their_messages(spark):
    groups = spark.createDataFrame([(1, 7, 1, T[0], 5, T[1]), (2, 7, 2, T[0], 9, None), (3, 8, 1, T[2], 1, T[3])],
                                   "id long, id_messagetype int, id_domain int, creation_time timestamp_ntz, priority int, process_start timestamp_ntz")
    messages = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "id long, id_bulkgroup long")
    out = {r.id: (r.messages, r.age_secs, r.in_process_secs) for r in Q.running_groups(groups, messages, T[4]).collect()}
    assert out == {1: (2, 14400.0, 10800.0), 3: (0, 7200.0, 3600.0)}
    by = {r.id_messagetype: r for r in Q.group_overview(groups, T[4]).collect()}
    assert (by[7].total, by[7].waiting, by[7].working, by[7].min_prio, by[7].max_prio, by[7].max_age_secs) == (2, 1, 1, 9, 5, 14400.0)
    assert "id_domain" in Q.group_overview(groups, T[4], by="id_domain").columns


def test_cache_history_sums_partitions_within_a_snapshot(spark):
    rows = [(T[0], 1, "O", "A", "P1", 10, 1), (T[0], 1, "O", "A", "P2", 20, 0), (T[1], 1, "O", "A", "P1", 6, 3), (T[5], 1, "O", "A", "P1", 500, 0), (T[1], 2, "O", "A", None, 1, 1)]
    cache = spark.createDataFrame(rows, "snapshot_ts timestamp_ntz, instance int, owner string, name string, partition_name string, blocks_total long, blocks_dirty long")
    r = SG.cache_history(cache, T[0], T[1], instance=1).collect()
    assert [tuple(x) for x in r] == [(1, "O", "A", None, 18.0, 6, 30, 36, 2.0, 1, 3, 2)]
    assert SG.cache_history(cache, T[0], T[1], partitions=True, limit=2).count() == 2
    assert [tuple(x) for x in SG.cache_history_detail(cache, T[0], T[5], "O", "A", 1, "P2").collect()] == [(T[0], 20, 0)]
    assert {tuple(x) for x in SG.cache_snapshot(cache, T[0], 1).collect()} == {("O", "A", None, 30, 1)}


def test_mutex_samples_end_is_exclusive(spark):
    rows = spark.createDataFrame([(T[0], 1, "a", 5), (T[1], 1, "a", 6), (T[2], 1, "a", 5), (T[1], 2, "a", 6), (T[1], 1, "b", 6)],
                                 "sleep_timestamp timestamp_ntz, inst_id int, mutex_type string, blocking_session int")
    assert CR.mutex_samples(rows, T[0], T[2]).count() == 4
    assert CR.mutex_samples(rows, T[0], T[2], 1, "a", {"blocking_session": 6}).count() == 1


def test_enqueue_per_snapshot_reads_the_snapshot_before(spark):
    fact = spark.createDataFrame([(1, 1, n, e, 10 * n * n, n) for n in range(1, 6) for e in (3, 4)] + [(1, 2, 2, 3, 0, 0)],
                                 "dbid int, instance_number int, snap_id int, event_id int, total_waits long, total_timeouts long")
    snaps = spark.createDataFrame([(1, i, n, T[n]) for n in range(1, 6) for i in (1, 2)], "dbid int, instance_number int, snap_id int, begin_interval_time timestamp_ntz")
    def got(a, b):
        return sorted(tuple(r) for r in CR.enqueue_per_snapshot(fact, snaps, 1, 1, 3, a, b).collect())
    assert got(3, 4) == [(T[3], 3, 50, 1), (T[4], 4, 70, 1)]
    assert got(1, 2) == [(T[1], 1, 0, 0), (T[2], 2, 30, 1)]


def test_dependent_tables_are_reached_through_other_types(spark):
    edges = spark.createDataFrame([("B", "A"), ("C", "B"), ("A", "A"), ("D", "A"), ("E", "X")], "child_table string, parent_table string")
    types = spark.createDataFrame([("O", "B", "T", "b"), ("O", "C", "M", "c"), ("P", "D", "M", "d"), ("O", "E", "M", "e")],
                                  "owner string, table_name string, table_type string, documentation string")
    got = lambda **k: {(r.child_table, r.level) for r in LK.dependent_tables(edges, types, "A", **k).collect()}
    assert got() == {("B", 1), ("C", 2), ("D", 1)}
    assert got(owner="O", table_type="M") == {("C", 2)}


def test_history_of_a_job_and_usage_records(spark):
    runs = spark.createDataFrame([(1, T[0], T[1]), (1, T[2], None), (2, T[0], T[1]), (1, dt.datetime(2023, 1, 1), T[0])], "job_id int, start_time timestamp_ntz, end_time timestamp_ntz")
    jobs = spark.createDataFrame([(1, "one")], "job_id int, job_name string")
    assert sorted((r.start_time, r.runtime_secs) for r in Q.job_history(runs, jobs, 1, T[5]).collect()) == [(T[0], 3600.0), (T[2], None)]
    lines = spark.createDataFrame([("ip1 db1 2024/01 c a 7",), ("ip1 db2 2024/01 c a 8",), ("ip2 db1 2024/02 c b 9",)], "line string")
    assert [r.request_id for r in Q.usage_records(lines, {"db": "db1", "action": "a"}).collect()] == ["7"]
    assert Q.usage_records(lines, {}).count() == 3


def test_redo_logs_count_all_members(spark):
    none = spark.createDataFrame([], "tablespace_name string, bytes long, autoextensible string, used_blocks long, contents string, block_size int")
    redo = spark.createDataFrame([(1, 1 << 20, 2, 512), (1, 1 << 20, 1, 512), (2, 2 << 20, 1, 512)], "inst_id int, bytes long, members int, block_size int")
    out = SG.tablespace_usage(none.select("tablespace_name", "contents", "block_size"), none, none, none, none, redo=redo).collect()
    assert {(r.tablespace_name, r.mb_total, r.mb_free, r.pct_used) for r in out} == {("Redo Inst=1", 3.0, 0.0, 100.0), ("Redo Inst=2", 2.0, 0.0, 100.0)}
