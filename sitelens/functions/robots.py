"""Rules of a robots file as a trie: an address is walked once, whatever the number of rules."""

from __future__ import annotations

from collections.abc import Iterable

END, ENDS_HERE, ANY, LOOPS = "end", "ends here", "any", "loops"  # keys of a node that no character can be


class RuleTrie:
    """Rules (allow, pattern). `*` stands for any run of characters, a `$` at a pattern's end for the address's end; all else is literal.

    Of the rules that fit, the one with the most characters other than `*` and `$` decides, and of equally long ones an allowing one.
    """

    def __init__(self, rules: Iterable[tuple[bool, str]]):
        self.root: dict = {}
        for allow, pattern in rules:
            anchored = pattern.endswith("$")
            node = self.root
            for c in pattern[:-1] if anchored else pattern:
                if c != "*":
                    node = node.setdefault(c, {})
                elif ANY not in node and not node.get(LOOPS):  # a second `*` in a row adds nothing
                    node[ANY] = {LOOPS: True}
                    node = node[ANY]
                else:
                    node = node.get(ANY, node)
            rank = (len(pattern.replace("*", "").replace("$", "")), allow)
            key = ENDS_HERE if anchored else END
            node[key] = max(node.get(key, rank), rank)

    def allowed(self, path: str) -> bool:
        """What the deciding rule says; True where none fits."""
        best = (-1, True)
        now = self._reached([self.root])
        for c in path:
            best = max([best, *(node[END] for node in now if END in node)])
            now = self._reached([node[c] for node in now if c in node] + [node for node in now if node.get(LOOPS)])
            if not now:
                return best[1]
        return max([best, *(node[key] for node in now for key in (END, ENDS_HERE) if key in node)])[1]

    @staticmethod
    def _reached(nodes: list[dict]) -> list[dict]:
        """The nodes, each once, and those behind their `*`, which may stand for nothing."""
        found = {id(node): node for node in nodes}
        found |= {id(node[ANY]): node[ANY] for node in nodes if ANY in node}
        return list(found.values())
