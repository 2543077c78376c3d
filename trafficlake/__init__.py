"""trafficlake: Spark DataFrame operators over captured LLM and agent traffic."""
