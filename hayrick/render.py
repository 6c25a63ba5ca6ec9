"""Answers as lines of text for people."""

from __future__ import annotations


def _lines(*parts: str | None) -> str:
    return "\n".join(p for p in parts if p)


def results(data: dict, warnings: list[str]) -> str:
    """One block a result: where it is, what it is, and the first line of what it says."""
    out = []
    for n, r in enumerate(data["results"], 1):
        doc = (r.get("docstring") or "").strip().split("\n")[0]
        out.append(_lines(f"{n:>2}. {r['path']}:{r['line']}  {r['qualname']}  [{r['kind']}, {r['source_role']}]  {r['score']:.3f}", f"    {r['signature']}" if r.get("signature") else None, f"    {doc}" if doc else None))
    foot = f"degraded: {', '.join(data['degradation_reasons'])}" if data["degraded"] else None
    return _lines("\n".join(out) or "nothing found", foot, *[f"warning: {w}" for w in warnings])


def page(data: dict) -> str:
    rows = [f"{s['path']}:{s['line']}  {s['kind']}  {s['qualname']}" for s in data["symbols"]]
    return _lines("\n".join(rows) or "no symbols", f"more from offset {data['next']}" if data["next"] is not None else None)


def status(data: dict) -> str:
    if not data["epoch"]:
        return f"index: {data['freshness']}"
    moved = ", ".join(f"{n} {what}" for what, n in data["drift"].items() if n) or "none"
    parsed = ", ".join(f"{n} {s}" for s, n in sorted(data["parse_coverage"].items())) or "none"
    return _lines(
        f"index: {data['freshness']}, epoch {data['epoch']}, commit {data['head'] or 'none'}",
        f"{data['symbols']} symbols in {data['files']} files, {data['vectors']} vectors ({data['without_vector']} missing)",
        f"parsed: {parsed}",
        f"moved since: {moved}",
        *[f"job {j['job_id']}: {j['mode']} {j['state']}" for j in data["jobs"]],
    )


def job(data: dict) -> str:
    counters = ", ".join(f"{k} {v}" for k, v in sorted(data["counters"].items()))
    failure = data["failure"]
    return _lines(f"job {data['job_id']}: {data['mode']} {data['state']}, epoch {data['epoch']}", counters or None, f"{failure['code']}: {failure['message']}. {failure['next_action']}" if failure else None)


def workspaces(data: dict) -> str:
    marks = lambda w: ", ".join(k for k in ("configured", "indexed") if w[k])
    return "\n".join(f"{w['root']}  ({marks(w)})" for w in data["workspaces"]) or "no workspaces"


def error(found: dict) -> str:
    rows = [f"  {v['field']}: {v['input']!r}, accepted: {', '.join(map(str, v['accepted']))}" for v in found.get("violations", [])]
    return _lines(f"{found['code']}: {found['message']}", *rows, found["next_action"])


def answer(call: str, envelope: dict) -> str:
    """The text of an envelope of search, map, status, index, job or workspaces."""
    if not envelope["ok"]:
        return error(envelope["error"])
    data = envelope["data"]
    if call == "search":
        return results(data, envelope["warnings"])
    return {"map": page, "status": status, "index": job, "job": job, "workspaces": workspaces}[call](data)
