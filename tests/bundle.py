"""A small captured tree with the cases that matter."""

import json
from pathlib import Path

A, B, C, D, E = (f"{x * 8}-0000-4000-8000-000000000000" for x in "abcde")
X, Y = (f"{x * 8}-1111-4000-8000-000000000000" for x in "12")
NODE = "99999999-2222-4000-8000-000000000000"


def alloc(i, **more):
    return {"ID": i, "JobID": "web", "Namespace": "default", "TaskGroup": "g", "NodeID": NODE, "EvalID": X, "ClientStatus": "running", "CreateTime": 1786728000000000000} | more


def make(root: Path) -> Path:
    b = root / "nomad-debug-2026"
    put = lambda rel, text: ((b / rel).parent.mkdir(parents=True, exist_ok=True), (b / rel).write_text(text, encoding="utf-8"))
    for k, (i, at) in enumerate((("0000", "17:18:10"), ("0001", "17:18:40"), ("0003", "17:19:40"))):
        put(f"interval/{i}/metrics.json", json.dumps({"Timestamp": f"2026-08-14 {at} +0000 UTC"}))
        status = "running" if k < 2 else "failed"
        rows = [alloc(A, ClientStatus=status, NextAllocation=B), alloc(B, PreviousAllocation=A, ClientDescription="" if k else "first"), alloc(C, PreviousAllocation=B), alloc(D, PreviousAllocation=B, NextAllocation=E)]
        put(f"interval/{i}/allocations.json", json.dumps(rows) if k != 1 else "\n".join(map(json.dumps, rows)) + "\n\nbroken line\n")
        put(f"interval/{i}/evaluations.json", json.dumps({"Evaluations": [{"ID": X, "JobID": "web", "Status": "complete", "NextEval": Y}, {"ID": Y, "JobID": "web", "Status": "blocked", "NextEval": X}]}))
        put(f"interval/{i}/nodes.json", json.dumps([{"ID": NODE, "Name": "n1", "Status": "ready", "Drain": False}]))
    put("interval/0003/jobs.json", "")
    put("interval/0003/deployments.json", "not json")
    stream = [
        {"Index": 5, "Topic": "Allocation", "Type": "AllocationUpdated", "Key": A, "FilterKeys": ["web"], "Payload": {"Allocation": alloc(A, NodeName="n1", ModifyTime=1786728001000000000, TaskStates={"t": {"State": "running"}})}},
        {"Index": 6, "Topic": "Node", "Type": "NodeDrain", "Key": NODE, "Payload": {"Node": {"ID": NODE, "ModifyTime": 1786728002000000000}}},
    ]
    put("cluster/eventstream.json", "\n".join(map(json.dumps, stream)) + "\n")
    line = f"2026-08-14T10:18:20.500-0700 [INFO] task restarting alloc={A}"
    put("server/s1/monitor.log", line + "\n" + f"2026-08-14T10:18:21.000-0700 GET /v1/agent/pprof/ {A}\n" + "2026-08-14T11:00:00.000-0700 late\n")
    put("client/c1/monitor.log", line + "\n" + f"no time {A} {A}\n")
    for i in ("0000", "0002"):
        put(f"server/s1/heap_{i}.prof", "x")
    put("server/s1/_hidden.log", "")
    put("index.json", "[1, 2]")
    (b / "link.log").symlink_to(b / "server/s1/monitor.log")
    return b
