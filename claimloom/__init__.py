"""claimloom: claim-triage and corpus analytics as Spark jobs."""
