"""assayer: evaluation analytics, rule inference, selection and corpus curation as Spark jobs."""
