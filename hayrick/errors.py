"""Errors that callers can act on."""

from __future__ import annotations

#: The codes are fixed values; the advice is this library's own.
ADVICE = {
    "REPOSITORY_NOT_SELECTED": "Name a collection: pass repo, an absolute path.",
    "REPOSITORY_NOT_FOUND": "No git work tree was found at that path; look for a typing error or clone it first.",
    "AMBIGUOUS_WORKSPACE": "Several collections fit. Say which one with repo.",
    "INDEX_NOT_READY": "Nothing has been published yet. Start refresh() and wait for its job to end.",
    "INDEX_PROFILE_MISMATCH": "The stored index was built with other settings; refresh() builds it anew.",
    "JOB_NOT_FOUND": "No job has this id here. List the jobs, or start another one.",
    "JOB_REPOSITORY_MISMATCH": "This job works on another collection; ask for it there.",
    "WORKSPACE_SCOPE_MISMATCH": "This session is bound to one collection; leave repo out or pass that one.",
    "INVALID_ARGUMENT": "Pass one of the accepted values.",
}


class HayrickError(Exception):
    def __init__(self, code: str, message: str, **details: object):
        super().__init__(message)
        self.code, self.message, self.details = code, message, details

    def payload(self) -> dict:
        action = self.details.get("next_action") or ADVICE.get(self.code, "The message says what went wrong.")
        return {"code": self.code, "message": self.message, "next_action": action} | {k: v for k, v in self.details.items() if k != "next_action"}


def envelope(repo: str | None, data: object = None, *, index: dict | None = None, warnings: list[str] | None = None, timings: dict | None = None, error: HayrickError | None = None) -> dict:
    if error:
        return {"ok": False, "repo": repo, "error": error.payload()}
    return {"ok": True, "repo": repo, "index": index, "data": data, "warnings": warnings or [], "timings": timings or {}}


# What a search accepts.
MODES = ("fast", "balanced", "deep")
INTENTS = ("implementation", "tests", "any")


def check_search(k: object, mode: object, intent: object) -> None:
    """All violations at once, in the order k, mode, intent. True and False are no numbers here."""
    found = []
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        found.append({"field": "k", "input": k, "accepted": ["integer >= 1"]})
    for name, value, known in (("mode", mode, MODES), ("intent", intent, INTENTS)):
        if value not in known:
            found.append({"field": name, "input": value, "accepted": list(known)})
    if found:
        raise HayrickError("INVALID_ARGUMENT", "invalid search arguments", violations=found, next_action="Each violation lists what its field accepts.")


def check_limit(limit: object, most: int = 500) -> None:
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= most:
        raise HayrickError("INVALID_ARGUMENT", "invalid limit", violations=[{"field": "limit", "input": limit, "accepted": [f"integer 1..{most}"]}], next_action="The violation lists what the field accepts.")
