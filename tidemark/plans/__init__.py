"""Multi-step plans built from the operators: staging, star schema, marts, monitors."""
