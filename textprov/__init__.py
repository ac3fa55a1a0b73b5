"""Text provenance analytics as Spark jobs: sentences, features, scores, calibration, verdicts, corpora, evaluation."""
