"""The closed vocabulary of the graph and the relation families that traversals name."""

from __future__ import annotations

# Node types, relations and provenances.
NODE_TYPES = """Repository File Module Directory Document Config Route Entrypoint Schema Function Method Class Interface
Type Variable Symbol Test External ShaderBinding BuildTarget BuildTest""".split()
RELATIONS = """CONTAINS DEFINES DECLARES EXPORTS CALLS INVOKES PASSES_THROUGH REFERENCES USES_TYPE EXTENDS IMPLEMENTS
OVERRIDDEN_BY IMPORTS INCLUDES DEPENDS_ON CONFIGURES TESTS MENTIONS LINKS_TO LOADS_SHADER DECLARES_BINDING
HAS_DIAGNOSTIC""".split()
EXECUTION = ["CALLS", "INVOKES", "PASSES_THROUGH"]
CALL = [*EXECUTION, "REFERENCES"]
IMPACT = [*CALL, "USES_TYPE", "TESTS"]
IMPORT = ["IMPORTS", "INCLUDES", "LOADS_SHADER"]
VERIFIED = "LSP_VERIFIED"
