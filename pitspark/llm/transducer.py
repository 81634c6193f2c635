"""Composition of the grammar of abusive language into one weighted machine, run over the words of a clause.

The lexicon is the first transducer: it writes each word as a symbol, the set of its classes. Rules, with the machines
they name put in, are one automaton over symbols; a second one beside it follows negation and speaking of oneself, and
its state is taken along from where a rule begins; a third one finds reporting. The product is determinised while it is
read, so that a clause of any length costs one step a word.
"""

from __future__ import annotations

import re

from pitspark.llm.abuse_grammar import CLASSES, MACHINES, ONESELF, REPORTING, RULES

#: What remains of a weight under negation, of oneself, and in reported speech.
NEGATED, SELF, REPORTED = 0.2, 0.2, 0.3
#: Words between a negation, or speaking of oneself, and what it governs.
NEGATION_REACH, SELF_REACH = 1, 3
#: What a foul word adds to the certainty of the rule it stands in, by class of arc.
ARC_WEIGHTS = {"FOUL": 0.2, "YOU": 0.1, "WEAPON": 0.2}
#: Transitions that are remembered before the table is begun anew.
MOST_STEPS = 400_000

_PART = re.compile(r"<\w+>|[A-Z]+|[a-z0-9]+|_|[\^$()|?*+]|\{\d+,\d+\}")
#: A people's name that no list has: an unknown word with such an ending.
_DEMONYM = re.compile(r"[a-z]{3,}(?:[bcdfghjklmnprstvz]is?|[a-z]nese|[a-z]ites)")
_COMMON = frozenset(
    "alibi alibis taxi taxis wifi spaghetti graffiti rabbi multi semi anti nazi nazis basis crisis thesis analysis emphasis hypothesis synthesis axis oasis diagnosis prognosis genesis tennis chassis debris bikini bikinis salami deli delis "
    "alumni fungi stimuli loci foci nuclei martini safari kiwi sushi tsunami origami corgi yogi mini midi casi asi apenas mis sus tis pais paris mais seis dois treis depois juli juni dais iris arthritis bronchitis hepatitis genesis catharsis "
    "praxis nemesis paralysis sepsis osmosis psychosis neurosis metropolis acropolis portis perdis lunis martis capitalis gratis".split()
)

_BOS, _EOS = "^", "$"


class _Builder:
    """Thompson's construction: states with empty arcs and arcs on a label."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.arcs: list[list[tuple[str, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.arcs.append([])
        return len(self.arcs) - 1

    def pattern(self, text: str) -> tuple[int, int]:
        parts = _PART.findall(text)
        if "".join(parts) != "".join(text.split()):
            raise ValueError(f"not a pattern: {text}")
        start, end, rest = self._choice(parts, 0)
        if rest != len(parts):
            raise ValueError(f"unbalanced: {text}")
        return start, end

    def _choice(self, parts: list[str], at: int) -> tuple[int, int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b, at = self._sequence(parts, at)
            self.empty[start].append(a)
            self.empty[b].append(end)
            if at < len(parts) and parts[at] == "|":
                at += 1
                continue
            return start, end, at

    def _sequence(self, parts: list[str], at: int) -> tuple[int, int, int]:
        start = end = self.state()
        while at < len(parts) and parts[at] not in "|)":
            begin = at
            a, b, at = self._atom(parts, at)
            if at < len(parts) and (parts[at] in "?*+" or parts[at][0] == "{"):
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(parts[at]) or tuple(map(int, parts[at][1:-1].split(",")))
                a, b = self._repeated(parts[begin:at], low, high)
                at += 1
            self.empty[end].append(a)
            end = b
        return start, end, at

    def _atom(self, parts: list[str], at: int) -> tuple[int, int, int]:
        if parts[at] == "(":
            a, b, at = self._choice(parts, at + 1)
            if at >= len(parts) or parts[at] != ")":
                raise ValueError("a bracket stays open")
            return a, b, at + 1
        if parts[at][0] == "<":
            a, b = self.pattern(MACHINES[parts[at][1:-1]])
            return a, b, at + 1
        a, b = self.state(), self.state()
        self.arcs[a].append((parts[at], b))
        return a, b, at + 1

    def _repeated(self, parts: list[str], low: int, high: int | None) -> tuple[int, int]:
        start = end = self.state()
        for k in range(high if high is not None else low + 1):
            a, b, _ = self._atom(parts, 0)
            self.empty[end].append(a)
            if k >= low:
                out = self.state()
                self.empty[end].append(out)
                self.empty[b].append(out)
                if high is None:
                    self.empty[b].append(a)
                b = out
            end = b
        return start, end


class Grammar:
    """The composed machine. Steps are worked out when they are first taken."""

    def __init__(self) -> None:
        nfa = _Builder()
        starts, self.accepts = [], {}
        for kind, weight, text in RULES:
            a, b = nfa.pattern(text)
            starts.append(a)
            self.accepts[b] = (kind, weight)
        for name, text in (("oneself", ONESELF), ("reporting", REPORTING)):
            a, b = nfa.pattern(text)
            starts.append(a)
            self.accepts[b] = (name, 1.0)
        self.closure = [self._closed(nfa, s) for s in range(len(nfa.arcs))]
        self.begin = tuple(sorted({s for a in starts for s in self.closure[a]}))
        self.arcs = nfa.arcs
        named = {label for arcs in nfa.arcs for label, _ in arcs}
        self.literals = {x for x in named if x.islower() or x.isdigit()}
        self.classes: dict[str, set[str]] = {}
        for name, words in CLASSES.items():
            for w in words.split():
                self.classes.setdefault(w, set()).add(name)
        unknown = named - self.literals - CLASSES.keys() - {"_", "DEMONYM", _BOS, _EOS}
        if unknown:
            raise ValueError(f"no such class: {unknown}")
        self.symbols: dict[frozenset[str], int] = {}
        self.labels: list[frozenset[str]] = []
        self.other, self.bos, self.eos = self._symbol(frozenset("_")), self._symbol(frozenset(_BOS)), self._symbol(frozenset(_EOS))
        self.of_word: dict[str, int] = {}
        self._reset()

    @staticmethod
    def _closed(nfa: _Builder, state: int) -> tuple[int, ...]:
        seen, todo = {state}, [state]
        while todo:
            for s in nfa.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return tuple(seen)

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[int, int]] = []
        self.found: list[tuple[tuple[str, float], ...]] = []
        self.taken = 0
        self._number((frozenset(), 0, 0, False), ())

    def _symbol(self, labels: frozenset[str]) -> int:
        if labels not in self.symbols:
            self.symbols[labels] = len(self.labels)
            self.labels.append(labels)
        return self.symbols[labels]

    def symbol(self, word: str) -> int:
        """The lexicon's output for a word."""
        got = self.of_word.get(word)
        if got is None:
            labels = set(self.classes.get(word, ()))
            if word in self.literals:
                labels.add(word)
            if not labels and word not in _COMMON and _DEMONYM.fullmatch(word):
                labels.add("DEMONYM")
            got = self._symbol(frozenset(labels | {"_"}))
            if len(self.of_word) < 500_000:
                self.of_word[word] = got
        return got

    def _number(self, state: tuple, found: tuple) -> int:
        key = (state, found)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.found.append(found)
        return self.numbers[key]

    def step(self, at: int, symbol: int) -> int:
        """One word further. A state holds the threads (place, context, certainty lost) and how near negation and self are."""
        threads, negation, oneself, reported = self.states[at]
        labels = self.labels[symbol]
        context = (negation > 0) + 2 * (oneself > 0)
        fresh = {(s, context): 0 for s in self.begin}
        for s, c, lost in threads:
            fresh[s, c] = max(fresh.get((s, c), 0), lost)
        after: dict[tuple[int, int], int] = {}
        for (s, c), lost in fresh.items():
            for label, to in self.arcs[s]:
                if label in labels:
                    more = lost + round(100 * ARC_WEIGHTS.get(label, 0.0))
                    for t in self.closure[to]:
                        after[t, c] = max(after.get((t, c), 0), more)
        found: dict[str, float] = {}
        own = False
        for (t, c), gained in after.items():
            if (accept := self.accepts.get(t)) is not None:
                kind, weight = accept
                if kind == "oneself":
                    own = True
                elif kind == "reporting":
                    reported = True
                else:
                    weight = 1 - (1 - weight) * (1 - min(gained, 80) / 100)
                    if c & 1 and kind != "harm":
                        weight *= NEGATED
                    if c & 2 and kind == "insult":
                        weight *= SELF
                    found[kind] = max(found.get(kind, 0.0), weight)
        kept = frozenset((t, c, min(g, 80)) for (t, c), g in after.items() if self.arcs[t])
        if "NEG" in labels:
            negation = NEGATION_REACH + 1
        elif negation:
            negation -= 1
        oneself = SELF_REACH + 1 if own else max(0, oneself - 1)
        self.taken += 1
        return self._number((kept, negation, oneself, reported), tuple(sorted(found.items())))

    def run(self, words: list[str]) -> tuple[dict[str, float], bool]:
        """The greatest weight of each kind that the rules find in a clause, and whether it reports."""
        if self.taken > MOST_STEPS:
            self._reset()
        at, kinds = 0, {}
        of_word, steps, found = self.of_word, self.steps, self.found
        for symbol in [self.bos, *[of_word[w] if w in of_word else self.symbol(w) for w in words], self.eos]:
            to = steps[at].get(symbol)
            if to is None:
                to = steps[at][symbol] = self.step(at, symbol)
            at = to
            if found[at]:
                for kind, weight in found[at]:
                    if weight > kinds.get(kind, 0.0):
                        kinds[kind] = weight
        return kinds, self.states[at][3]
