"""Threat detection over security logs as ordinary Spark DataFrame jobs."""
