"""Command line for a rule file: ``python -m veilspark.rules_cli --rules FILE {list,add,test,remove}``.

Exit codes: 0 done, 1 refused or nothing found, 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .operators.detect import ENTITIES
from .operators.rules import RuleError
from .sources.io import RuleFile


def show(args: argparse.Namespace) -> int:
    told = RuleFile(args.rules).describe()
    if not args.own_only:
        told["builtin"] = list(ENTITIES)
    if args.json:
        print(json.dumps(told, ensure_ascii=False, indent=2))
        return 0
    for warning in filter(None, (told["load_error"], told["permission_warning"])):
        print(f"! {warning}")
    print(f"active: {len(told['active'])}")
    for r in told["active"]:
        print(f"  {r['name']}: {r['type']}, <{r['entity']}_N>, score {r['score']}")
    print(f"not active: {len(told['quarantined'])}")
    for r in told["quarantined"]:
        print(f"  {r['name']}: {r['reason']}")
    if not args.own_only:
        print("built in: " + ", ".join(ENTITIES))
    return 0


def add(args: argparse.Namespace) -> int:
    if (args.term is None) == (args.regex is None):
        print("give one of --term and --regex", file=sys.stderr)
        return 2
    rule = {"name": args.name, "entity": args.entity, "type": "term" if args.term is not None else "regex", "value": args.term if args.term is not None else args.regex, "examples": args.example}
    rule |= {k: v for k, v in (("counter_examples", args.counter_example), ("score", args.score), ("case_sensitive", args.case_sensitive)) if v not in (None, False)}
    RuleFile(args.rules).add(rule)
    print(f"{args.name} is active; the next request uses it")
    return 0


def test(args: argparse.Namespace) -> int:
    text = " ".join(args.text) if args.text else Path(args.file).read_text(encoding="utf-8") if args.file else sys.stdin.read()
    hits, masked = RuleFile(args.rules).preview(text)
    if not hits:
        print("no own rule matches (built-in detectors are not asked here)")
        return 1
    for h in hits:
        print(f"  {text[h['start'] : h['end']]!r} -> <{h['entity_type']}> by {h['name']}")
    print(masked)
    return 0


def remove(args: argparse.Namespace) -> int:
    RuleFile(args.rules).remove(args.name)
    print(f"{args.name} is removed")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilspark.rules_cli", description="Own terms and patterns of a rule file.")
    parser.add_argument("--rules", required=True, help="the rule file")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("list", help="rules that are active and rules that are set aside")
    p.add_argument("--json", action="store_true")
    p.add_argument("--own-only", action="store_true")
    p.set_defaults(run=show)
    p = commands.add_parser("add", help="check a rule and keep it")
    p.add_argument("name")
    p.add_argument("--entity", required=True)
    p.add_argument("--term")
    p.add_argument("--regex")
    p.add_argument("--example", action="append", required=True)
    p.add_argument("--counter-example", action="append")
    p.add_argument("--score", type=float)
    p.add_argument("--case-sensitive", action="store_true")
    p.set_defaults(run=add)
    p = commands.add_parser("test", help="what the own rules find in a text, and the text as it leaves")
    p.add_argument("text", nargs="*")
    p.add_argument("--file")
    p.set_defaults(run=test)
    p = commands.add_parser("remove", help="take a rule out")
    p.add_argument("name")
    p.set_defaults(run=remove)
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except RuleError as e:
        print(f"{e}; the file is as it was", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
