"""caseflow: process analytics over event logs, expressed as Spark DataFrame plans."""
