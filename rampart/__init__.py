"""rampart: code, prompt and package security analytics as Spark dataflows."""
