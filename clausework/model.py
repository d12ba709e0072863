"""Fixed values of the policy vocabulary, and the options of a validation."""

from __future__ import annotations

from dataclasses import dataclass, field

ODRL = "http://www.w3.org/ns/odrl/2/"
CC = "http://creativecommons.org/ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

# The terms of ODRL 2.2, by kind; core, common and deprecated ones.
CORE_TERMS = {
    "PolicyClass": "Agreement Offer Policy Set",
    "RuleClass": "Duty Permission Prohibition Rule",
    "AssetClass": "Asset AssetCollection",
    "PartyClass": "Party PartyCollection",
    "PartyFunction": "assignee assigner",
    "AssetRelation": "target",
    "Action": "transfer use",
    "Operator": "eq gt gteq hasPart isA isAllOf isAnyOf isNoneOf isPartOf lt lteq neq",
    "ConflictTerm": "invalid perm prohibit",
    "LogicalOperand": "and andSequence or xone",
}
COMMON_TERMS = {
    "PolicyClass": "Assertion Privacy Request Ticket",
    "PartyFunction": "attributedParty attributingParty compensatedParty compensatingParty consentedParty consentingParty "
    "contractedParty contractingParty informedParty informingParty trackedParty trackingParty",
    "AssetRelation": "output",
    "Action": "acceptTracking aggregate annotate anonymize archive attribute compensate concurrentUse delete derive digitize display "
    "distribute ensureExclusivity execute extract give grantUse include index inform install modify move nextPolicy obtainConsent play "
    "present print read reproduce reviewPolicy sell stream synchronize textToSpeech transform translate uninstall watermark",
    "LeftOperand": "absolutePosition absoluteSize absoluteSpatialPosition absoluteTemporalPosition count dateTime delayPeriod "
    "deliveryChannel elapsedTime event fileFormat industry language media meteredTime payAmount percentage product purpose recipient "
    "relativePosition relativeSize relativeSpatialPosition relativeTemporalPosition resolution spatial spatialCoordinates systemDevice "
    "timeInterval unitOfCount version virtualLocation",
    "RightOperand": "policyUsage",
}
DEPRECATED_TERMS = {
    "Action": "adHocShare append appendTo attachPolicy attachSource commercialize copy export extractChar extractPage extractWord "
    "lease lend license pay preview secondaryUse share shareAlike write writeTo",
    "LeftOperand": "device system",
}
CC_ACTIONS = "Attribution CommercialUse DerivativeWorks Distribution Notice Reproduction ShareAlike Sharing SourceCode"


def odrl_terms() -> list[tuple[str, str, bool, bool]]:
    """(iri, kind, core, deprecated) of the built-in vocabulary."""
    out = [(ODRL + t, kind, True, False) for kind, names in CORE_TERMS.items() for t in names.split()]
    out += [(ODRL + t, kind, False, False) for kind, names in COMMON_TERMS.items() for t in names.split()]
    out += [(CC + t, "Action", False, False) for t in CC_ACTIONS.split()]
    return out + [(ODRL + t, kind, False, True) for kind, names in DEPRECATED_TERMS.items() for t in names.split()]


# Rule, tier, advisory level, strict level, level where a hint is closed ("" if none), gap, since ruleset.
RULES = [
    ("profile.not-loaded", "profile", "warning", "error", "", True, 1),
    ("profile.import-not-loaded", "profile", "off", "warning", "", True, 1),
    ("profile.undeclared-in-namespace", "profile", "warning", "error", "", False, 1),
    ("profile.unknown-term", "profile", "off", "error", "", False, 1),
    ("profile.wrong-kind", "profile", "off", "error", "", False, 1),
    ("profile.not-declared", "profile", "off", "error", "", False, 1),
    ("profile.conflict-term", "profile", "off", "error", "", False, 1),
    ("profile.unbound-prefix", "profile", "off", "error", "", False, 1),
    ("profile.deprecated-term", "profile", "warning", "warning", "", False, 1),
    ("odrl.policy-uid", "odrl", "off", "error", "", False, 1),
    ("odrl.no-rule", "odrl", "off", "error", "", False, 1),
    ("odrl.offer-assigner", "odrl", "off", "error", "", False, 1),
    ("odrl.agreement-parties", "odrl", "off", "error", "", False, 1),
    ("odrl.rule-target", "odrl", "off", "error", "", False, 1),
    ("odrl.rule-action", "odrl", "off", "error", "", False, 1),
    ("odrl.constraint-shape", "odrl", "off", "error", "", False, 1),
    ("odrl.set-operator-cardinality", "odrl", "off", "error", "", False, 1),
    ("odrl.consequence-nesting", "odrl", "off", "error", "", False, 1),
    ("odrl.inheritance-cycle", "odrl", "off", "error", "", False, 1),
    ("odrl.constraint-incomplete", "odrl", "off", "error", "", False, 2),
    ("prose.operator-not-allowed", "prose", "info", "info", "error", False, 1),
    ("prose.value-not-allowed", "prose", "off", "info", "error", False, 1),
    ("prose.iri-expected", "prose", "off", "off", "error", False, 1),
    ("prose.unit-not-allowed", "prose", "off", "info", "error", False, 1),
    ("prose.datatype-lexical", "prose", "info", "info", "error", False, 1),
    ("prose.datatype-conflict", "prose", "off", "warning", "error", False, 1),
    ("prose.ill-typed-literal", "prose", "off", "error", "", False, 1),
    ("input.unreadable", "input", "error", "error", "", False, 1),
    ("input.unchecked", "input", "off", "warning", "", True, 1),
    ("input.reader-note", "input", "off", "info", "", False, 1),
    ("heuristic.ordered-on-unordered", "heuristic", "off", "off", "", False, 1),
    ("heuristic.single-child-group", "heuristic", "off", "off", "", False, 2),
    ("heuristic.duplicate-action", "heuristic", "off", "off", "", False, 2),
]
RULESET = 2


@dataclass(frozen=True)
class Options:
    """How strictly to validate."""

    strict: bool = True
    structural: bool = True
    ruleset: int = RULESET
    fail_closed: bool = False
    deny_deprecated: bool = False
    levels: dict[str, str] = field(default_factory=dict)

    def level(self, rule: str, closed: bool = False) -> str:
        """Level of a rule: its own setting, then the ruleset, the structural switch, the mode, the closed column."""
        _, tier, advisory, strict, shut, _, since = next(r for r in RULES if r[0] == rule)
        if rule == "input.unreadable":
            return "error"
        if rule in self.levels:
            return self.levels[rule]
        if rule == "input.unchecked" and self.fail_closed or rule == "profile.deprecated-term" and self.deny_deprecated:
            return "error"
        if since > self.ruleset:
            return "off"
        if tier == "odrl" and not self.structural and not (rule == "odrl.constraint-incomplete" and self.strict):
            return "off"
        if closed and self.strict and shut:
            return shut
        return strict if self.strict else advisory

    def table(self) -> list[tuple[str, str, bool, str, bool]]:
        """(rule, tier, closed, level, gap) for the broadcast join of severities."""
        return [
            (rule, tier, closed, self.level(rule, closed), gap and not (self.fail_closed and rule == "input.unchecked"))
            for rule, tier, _, _, _, gap, _ in RULES
            for closed in (False, True)
        ]


# Group and name of each feature of the coverage table, in its order.
FEATURES = [
    *[("Policy types", x) for x in "Set Offer Agreement Request Ticket Privacy Assertion Policy".split()],
    *[("Rules", x) for x in "permission prohibition obligation duty remedy consequence".split()],
    *[("Conditions", x) for x in "constraint refinement and or xone andSequence rightOperandReference unit dataType".split()],
    *[("Policy terms", x) for x in "profile inheritFrom conflict".split()],
    *[
        ("Parties and assets", x)
        for x in "assigner assignee attributedParty compensatedParty trackingParty informedParty consentingParty consentedParty "
        "AssetCollection PartyCollection partOf source".split()
    ],
]

# Noun phrases of left operands.
OPERAND_PHRASES = {
    "dateTime": "the date and time",
    "elapsedTime": "the elapsed time",
    "meteredTime": "the metered time",
    "delayPeriod": "the delay period",
    "spatial": "the location",
    "spatialCoordinates": "the coordinates",
    "payAmount": "the payment amount",
    "count": "the number of times used",
    "deliveryChannel": "the delivery channel",
    "fileFormat": "the file format",
    "industry": "the industry",
    "language": "the language",
    "media": "the media",
    "product": "the product",
    "purpose": "the purpose",
    "recipient": "the recipient",
    "systemDevice": "the system or device",
    "unitOfCount": "the unit of count",
    "version": "the version",
    "virtualLocation": "the virtual location",
    "event": "the event",
    "percentage": "the percentage",
    "resolution": "the resolution",
    "timeInterval": "the time interval",
}
# Verb phrases of operators: for any operand, for a point in time, for a whole day.
OPERATOR_PHRASES = {
    "any": {
        "eq": "is equal to",
        "neq": "is not equal to",
        "gt": "is greater than",
        "gteq": "is at least",
        "lt": "is less than",
        "lteq": "is at most",
        "isA": "is a kind of",
        "hasPart": "has as a part",
        "isPartOf": "is part of",
        "isAllOf": "is all of",
        "isAnyOf": "is any of",
        "isNoneOf": "is none of",
    },
    "instant": {"lt": "is before", "lteq": "is on or before", "gt": "is after", "gteq": "is on or after"},
    "day": {
        "lt": "is before the start of",
        "lteq": "is on or before the end of",
        "gt": "is after the end of",
        "gteq": "is on or after the start of",
    },
}
# Actions that have a phrase of their own.
ACTION_PHRASES = {
    "grantUse": "grant use of",
    "nextPolicy": "pass on the next policy for",
    "textToSpeech": "convert to speech",
    "attribution": "attribute",
}
