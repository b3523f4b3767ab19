"""Fixed values shared by the queries and their SQL."""

#: Names of the two routes of a gated prediction, and the response given to gated rows.
GATE_PHASES = ("Phase 1 (Filter)", "Phase 2 (LLM)")
GATED_RESPONSE = "Filtered by Moderation"
