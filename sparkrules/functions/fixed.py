"""Word lists, tables and formats that decide results. Data only, no logic."""

# --- fixed values: ordered spelling replacements (applied one after the other) ---------------
REPLACEMENTS = [
    ("croosSectionalArea", "crossSectionalArea"),
    ("cross-sectionalArea", "crossSectionalArea"),
    ("waterseal", "waterSeal"),
    ("use", "usage"),
    ("exists", "isExist"),
    ("IsExist", "isExist"),
    ("centres", "centre"),
    ("intallation", "installation"),
    ("temperate", "temperature"),
    ("between", "inBetween"),
    ("joints", "joint"),
    ("basis", "base"),
    ("dependence", "dependency"),
    ("walTie", "wallTie"),
    ("wallTies", "wallTie"),
    ("changesOfDirection", "changeInDirection"),
    ("Flashing", "flashing"),
    ("galvanized", "galvanised"),
    ("U5", "u5"),
    ("kickout", "kickOut"),
    ("Ind.LiquidWaste", "industrialLiquidWaste"),
    ("dimensionValue", "value"),
    ("G300", "g300"),
    ("G550", "g550"),
    ("D10 rod", "d10Rod"),
    ("walls", "wall"),
    ("fascias", "fascia"),
    ("barges", "barge"),
    ("eaves", "eave"),
    ("mortarJoints", "mortarJoint"),
    ("contaminants", "contaminant"),
    ("drainedcavity", "drainedCavity"),
    ("ventpipe", "ventPipe"),
    ("nails", "nail"),
    ("points", "point"),
    ("exitways", "exitway"),
    ("&", "and"),
    ("as3566-part2", "as_3566.2"),
    ("nzbc-g12", "nzbc_g12"),
]

# --- fixed values: short and long schema terms ------------------------------------------------
SCHEMA_TERMS = [
    ("base unit(", "baseunit("),
    ("fun(", "function("),
    ("var(", "variable("),
    ("rel(", "relation("),
    ("expr(", "expression("),
]
# 'base unit' is a repair of spacing, not a short form, so it has no way back.
SCHEMA_TERMS_BACK = [pair for pair in SCHEMA_TERMS if pair[0] != "base unit("]

# --- fixed values: unit tables ----------------------------------------------------------------
UNIT_KINDS = [
    ("metre", "m"),
    ("gram", "g"),
    ("litre", "l"),
    ("newton", "N"),
    ("pascal", "Pa"),
    ("angleDegree", "deg"),
    ("celsius", "degC"),
    ("hectare", "ha"),
]
UNIT_PREFIXES = [("kilo", "k"), ("milli", "m"), ("mega", "M")]
UNIT_OPERATORS = [("addition", "+"), ("subtraction", "-"), ("multiplication", "*"), ("division", "/")]

# --- fixed values: rule vocabulary ------------------------------------------------------------
CONNECTORS = ["and", "or"]
DEONTICS = ["obligation", "permission", "prohibition"]
KEYWORDS = ["if", "then", "and", "or", "obligation", "permission", "prohibition", "not", "loop"]
STRUCTURE_WORDS = [
    "expression", "expr", "appliedstatement", "rulestatement", "atom", "function", "fun", "relation", "rel",
    "variable", "var", "data", "baseunit", "derivedunit", "prefix", "kind", "operator", "value",
]

# --- fixed values: notation levels, and what is short in each ------------------------------------
NOTATION_LEVELS = {
    "base": [],
    "unit": ["units"],
    "u_ao": ["units", "values"],
    "u_ao_atom": ["units", "values", "atoms"],
    "u_ao_at_expr": ["units", "values", "atoms", "expressions"],
    "u_ao_at_ex_loop": ["units", "values", "atoms", "expressions", "loops"],
    "u_atom": ["units", "atoms"],
    "u_at_expr": ["units", "atoms", "expressions"],
    "u_at_ex_loop": ["units", "atoms", "expressions", "loops"],
}

# --- fixed values: comment tags, by group -----------------------------------------------------
TAG_GROUPS = {
    "ignore": [
        "Abstract", "CausesNotTranslated", "ContextIgnore", "FilteringRequiredByModel", "Ignore",
        "LearnToIgnore", "LearnToIgnoreFigure", "ModelIgnoreExplanation", "NotEncodedParts",
        "OrOtherOnly", "ReferenceNotTranslated", "ReferenceOverDescription", "RemovableContext",
        "SomeDetailsNotEncoded", "UselessInfoInBrackets",
    ],
    "fine": ["Detailed", "DetailedParts", "FineGrained", "AndOrDetailed", "CoarseThenFine"],
    "tacit": [
        "DomainKnowledge", "MissingInformation", "Tacit", "Tacit - Formula", "TacitReference",
        "UnpredictableParts", "ImplicitPrecondition",
    ],
    "coarse": ["LongData", "LongEntities", "SplitableEntities"],
    "medium": ["MediumData", "OneSplitableEntity", "PartlyAbstract", "SomeLongEntities", "CoarseThenFine"],
}
ADDED_MARKER = "TACIT-"
CONDITION_WORDS = {
    "medium": "medium-grained",
    "coarse": "coarse-grained",
    "fine": "fine-grained",
    "tacit": "implicit",
    "ignore": "ignore",
}
# label -> literal text in the rule
RULE_MARKS = {
    "define": "function( define)",
    "rulestatement": "rulestatement(",
    "key": "relation( key",
}

# --- fixed values: prompt and input formats ---------------------------------------------------
SOURCE_MARK = "Source: "
TARGET_MARK = "Target:"
STEP_BY_STEP = "Let's think step by step:\n"
SEPARATOR = "<sep>"
END_TOKEN = "</s>"
MASK_TOKEN = "<mask>"
WHITESPACE = " \t\n\r\f\v"
