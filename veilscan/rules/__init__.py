"""Rule catalog and rule sets."""

from veilscan.rules.catalog import PRIVATE_KEY_HEADER, Rule, builtin_rules
from veilscan.rules.ruleset import (
    RuleError,
    RuleSet,
    compile_custom_rule,
    effective_rules,
    load_custom_rules,
)

__all__ = [
    "PRIVATE_KEY_HEADER", "Rule", "RuleError", "RuleSet", "builtin_rules", "compile_custom_rule",
    "effective_rules", "load_custom_rules",
]
