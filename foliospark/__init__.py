"""Document-structure analytics and job control as PySpark DataFrame operators."""
