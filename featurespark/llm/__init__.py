"""Operators that prepare text for language-model training, each as a Spark job."""
