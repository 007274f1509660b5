"""Spark jobs for rubric documents and recorded skills assessments."""
