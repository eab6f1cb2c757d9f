"""Marlstone: hybrid retrieval, document analytics and corpus preparation as Spark jobs."""
