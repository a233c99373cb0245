"""Training-data operators.  Nothing outside this folder imports it; the
queries are registered through ``wordloom.llm.registry``."""
