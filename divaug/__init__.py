"""divaug: diversity-oriented augmentation analytics as Spark DataFrame jobs.

Subpackages
-----------
functions   Column-expression helpers (vectors, text, hashing).  Pure
            expressions: nothing here triggers a job.
sources     Readers, writers, split catalog and the fixture views derived
            from the driver tables.
operators   DataFrame -> DataFrame operators (sampling, training-dynamics
            scores, coreset selection, candidates, diversity, evaluation).
plans       End-to-end jobs composed from operators, and the query registry.
streaming   Structured Streaming versions of the training-log scores.
"""

__all__ = ["session"]
