"""An approval-gated session over the engine: a small driver-side state machine with injected functions.

Gates: after a rubric is compiled, and after briefs are rendered. State is a plain dict, saved as JSON after each step, so
a session can go on after a restart. Nothing is sent without the last approval.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

BUDGET = 40
RUBRIC_GATE, SUMMARY_GATE, DONE = "approve_rubric", "approve_summary", "done"
#: What each decision at a gate leads to.
NEXT = {
    RUBRIC_GATE: {"approve": "match", "amend": "compile", "ask": "answer"},
    SUMMARY_GATE: {"approve": "send", "edit": "render", "change_rubric": "compile", "ask": "answer"},
}


class CallBudgetExceeded(RuntimeError):
    pass


def resume_payload(decision: str, detail: str = "") -> dict:
    """The message that a gate takes for a decision."""
    field = {"approve": None, "reject": None, "amend": "guidance", "change_rubric": "guidance", "ask": "question", "edit": "note"}
    if decision not in field:
        raise ValueError(f"unknown decision: {decision}")
    return {"decision": decision} | ({field[decision]: detail} if field[decision] else {})


def parse_command(line: str) -> dict:
    """A typed line as a decision: "approve", "reject", or a word and its text, such as "amend: drop Docker"."""
    word, _, rest = line.strip().partition(":")
    return resume_payload(word.strip().lower(), rest.strip())


@dataclass
class Session:
    """compile(role_id, guidance) -> rubric; match(rubric) -> results; render(results, note) -> markdown; answer(question, state) -> text; send(markdown) -> receipt."""

    compile: Callable
    match: Callable
    render: Callable
    answer: Callable
    send: Callable
    store: Path | None = None
    budget: int = BUDGET

    def start(self, role_id: str, calls: int = 0) -> dict:
        return self._run({"role_id": role_id, "guidance": "", "note": None, "calls": calls}, "compile")

    def switch(self, state: dict, role_id: str) -> dict:
        """A new role starts afresh; only the calls made so far count on."""
        return self.start(role_id, state["calls"])

    def resume(self, state: dict, message: dict) -> dict:
        step = NEXT[state["gate"]].get(message["decision"])
        if step is None:
            return self._save(state | {"gate": DONE})
        state = dict(state)
        if "guidance" in message:
            state["guidance"] = f"{state['guidance']}\n{message['guidance']}".strip()
        state["note"] = message.get("note")
        return self._run(state, step, message.get("question"))

    def load(self) -> dict:
        return json.loads(self.store.read_text())

    def _call(self, state: dict) -> None:
        if state["calls"] >= self.budget:
            raise CallBudgetExceeded(f"{state['calls']} calls made, {self.budget} allowed")
        state["calls"] += 1

    def _run(self, state: dict, step: str, question: str | None = None) -> dict:
        if step == "compile":
            self._call(state)
            state |= {"rubric": self.compile(state["role_id"], state["guidance"]), "gate": RUBRIC_GATE}
        elif step == "answer":
            self._call(state)
            state["answer"] = self.answer(question, state)
        elif step == "send":
            state |= {"receipt": self.send(state["markdown"]), "gate": DONE}
        else:
            if step == "match":
                state["results"] = self.match(state["rubric"])
            self._call(state)
            state |= {"markdown": self.render(state["results"], state["note"]), "gate": SUMMARY_GATE, "note": None}
        return self._save(state)

    def _save(self, state: dict) -> dict:
        if self.store:
            self.store.write_text(json.dumps(state, default=str))
        return state
