"""A PySpark engine for personal-genotype analytics, with operators for training-data pipelines in ``helixloom.llm``."""
