"""Detection of the kind of a configuration file: four rule sets with different precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base_name, suffix

#: Content markers.
CLOUDFORMATION = r"(?m)(^AWSTemplateFormatVersion:|^Resources:\s*$|Type:\s*AWS::)"
KUBERNETES = (
    r"(?m)(^apiVersion:\s*(apps|batch|rbac\.authorization|networking|policy)/|^kind:\s*(Deployment|Pod|Service|Ingress|ConfigMap|Secret|DaemonSet|"
    r"StatefulSet|ReplicaSet|Job|CronJob|ClusterRole|Role|RoleBinding|NetworkPolicy|PersistentVolumeClaim)\b)"
)
ANSIBLE = r"(?m)(^-\s+name:|^\s+hosts:|^\s+tasks:|^\s+become:|ansible\.builtin\.)"
TERRAFORM = r"""(?m)(^resource\s+"[a-z][a-z0-9_]+"|\bprovider\s+"[a-z][a-z0-9_-]*"|\bterraform\s*\{|\bdata\s+"[a-z][a-z0-9_]+"\s+"[a-z][a-z0-9_]+")"""
DOCKER_START = r"(?i)^\s*(FROM|ARG)\s+\S"
KUBERNETES_PARTS = ("kubernetes", "k8s", "manifests", "charts", "helm")
ANSIBLE_PARTS = ("ansible", "playbooks", "roles", "tasks")
SIGNATURES = [
    ("kubernetes", r"(?m)apiVersion:|kind:\s+(Deployment|Pod|Service|ConfigMap)"),
    ("terraform", r'(?m)resource\s+"|provider\s+"|terraform\s*\{'),
    ("ansible", r"(?m)^\s*-\s+name:|^\s*hosts:|^\s*tasks:"),
    ("docker", r"(?m)^FROM\s+|^RUN\s+|^EXPOSE\s+"),
]
CONFIG_SUFFIXES = (".tf", ".tfvars", ".yml", ".yaml", ".json", ".dockerfile")


def detect_tool(path: Column, content: Column) -> Column:
    """By name, then by content (precedence matters: several kinds are YAML), then by path parts."""
    name, ext = F.lower(base_name(path)), suffix(path)
    parts = F.split(F.lower(path), "/")
    yaml = ext.isin(".yml", ".yaml")
    marked = F.coalesce(content, F.lit(""))
    inside = lambda words: F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))
    return (
        F.when(name.contains("dockerfile") | (ext == ".dockerfile"), "docker")
        .when(ext.isin(".tf", ".tfvars"), "terraform")
        .when(marked.rlike(CLOUDFORMATION), "cloudformation")
        .when(marked.rlike(KUBERNETES), "kubernetes")
        .when(marked.rlike(ANSIBLE), "ansible")
        .when(marked.rlike(TERRAFORM), "terraform")
        .when(marked.rlike(DOCKER_START), "docker")
        .when(yaml & inside(KUBERNETES_PARTS), "kubernetes")
        .when(yaml & inside(ANSIBLE_PARTS), "ansible")
        .otherwise("unknown")
    )


def analyzer_tool(path: Column, content: Column) -> Column:
    by_content = reduce(lambda w, x: w.when(content.rlike(x[1]), x[0]), SIGNATURES, F.when(suffix(path) == ".tf", "terraform").when(F.lower(base_name(path)).startswith("dockerfile"), "docker"))
    return by_content.otherwise("unknown")


def guess_tool(path: Column, content: Column) -> Column:
    """From the name and the first 500 characters; YAML without a sign is kubernetes."""
    head, name, ext = F.substring(content, 1, 500), F.lower(base_name(path)), suffix(path)
    yaml = ext.isin(".yml", ".yaml")
    return (
        F.when(ext == ".tf", "terraform")
        .when(name.contains("dockerfile"), "docker")
        .when(yaml & head.contains("apiVersion:") & head.contains("kind:"), "kubernetes")
        .when(yaml & (head.contains("hosts:") | head.contains("tasks:")), "ansible")
        .when(yaml, "kubernetes")
        .when((ext == ".json") & name.contains("cloudformation"), "cloudformation")
        .otherwise("unknown")
    )


def platform(path: Column, content: Column) -> Column:
    """Platform name as scanners spell it, from the name and the first 300 characters."""
    head, name, ext = F.substring(content, 1, 300), F.lower(base_name(path)), suffix(path)
    yaml = ext.isin(".yml", ".yaml")
    return (
        F.when(ext == ".tf", "Terraform")
        .when(name.contains("dockerfile"), "Dockerfile")
        .when(yaml & head.contains("apiVersion:"), "Kubernetes")
        .when(yaml & (head.contains("hosts:") | head.contains("tasks:")), "Ansible")
        .when(yaml, "Kubernetes")
        .when(ext == ".json", "CloudFormation")
        .otherwise("Terraform")
    )


def is_config_path(path: Column) -> Column:
    return F.lower(base_name(path)).isin("dockerfile", "vagrantfile") | suffix(path).isin(*CONFIG_SUFFIXES)


def is_config_file(path: Column, content: Column) -> Column:
    """Whether the kind of a file is known."""
    return detect_tool(path, content) != "unknown"
